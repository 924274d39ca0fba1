"""Operators of a training-data pipeline: quality rules, deduplication,
decontamination, filtering, tokenisation output and packing.

Nothing outside this subpackage imports it but ``__spark_entry__.py`` and
``corpus_pipeline.py``.
"""
