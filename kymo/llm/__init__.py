"""Operators for preparing training text: deduplication, filtering, scoring, tokenising and packing.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
