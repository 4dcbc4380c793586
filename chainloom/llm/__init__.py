"""Operators for training-data pipelines: scoring, scanning, searching, mixing, deduplication, packing and extraction.

Nothing else in the library imports this package.  Every operator takes and returns DataFrames; the registered queries
are in ``queries.py``, the five-stage pipeline in ``corpus_pipeline.py`` at the top of the repository.
"""
