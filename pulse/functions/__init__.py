"""Column-expression functions: cleaning, rule scores, tiers (no Python UDFs)."""
