"""Operators of a large-scale training-data pipeline.

Every module holds one operator with a general interface; ``queries`` registers one thin query per operator.
Nothing outside this folder, ``corpus_pipeline.py`` and the guard in ``__spark_entry__.py`` imports it.
"""
