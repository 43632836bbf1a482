"""Operators for preparing training text: deduplication, scoring, rules, scans, sharding, tokens."""
