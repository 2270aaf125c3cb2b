"""Operators of a training-data pipeline; nothing outside this folder and corpus_pipeline.py imports them."""
