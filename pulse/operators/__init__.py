"""Relational operators: cohort selection, clock re-basing, point-in-time panels, labels."""
