"""Structural code search on Spark: snippets -> syntax-tree nodes -> terms -> postings -> ranked hits."""
__version__ = "0.1.0"
