"""Operators that turn a raw corpus into training data.

Nothing outside this folder imports it, apart from ``corpus_pipeline`` and the guarded
import in ``__spark_entry__``.
"""
