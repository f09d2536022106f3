"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this folder, ``corpus_pipeline.py`` and
``tests/llm`` imports it, and it imports nothing from the rest of the library.
"""
