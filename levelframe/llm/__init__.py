"""Operators for preparing training text: sharding, filtering, deduplication, scoring, mixing."""
