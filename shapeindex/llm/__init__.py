"""Operators of a training-data pipeline: sharding, search, deduplication, decontamination, extraction, scoring, tokens.

Nothing outside this folder (but for ``corpus_pipeline.py`` and the guard of ``__spark_entry__.py``) imports it.
"""
