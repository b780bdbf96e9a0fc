"""Operators for training-data corpora; nothing outside this folder and corpus_pipeline.py imports it."""
