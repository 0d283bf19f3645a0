"""Operators for preparing training corpora: dedup, sharding, filtering, scoring, search and tokens."""
