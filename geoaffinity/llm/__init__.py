"""Operators of a training-data pipeline: cleaning, deduplication, scoring, tokens, search and mixing."""
