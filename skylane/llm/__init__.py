"""Operators for training-data pipelines (deduplication, scans, packing).

Nothing else in the library imports this subpackage; its queries are in
``skylane.llm.queries`` and the stages that chain them in
``corpus_pipeline.py``.
"""
