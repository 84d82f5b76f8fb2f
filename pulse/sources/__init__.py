"""Scans, the demo mapping onto the five learner tables, nested sources, validation, sinks."""
