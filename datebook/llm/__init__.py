"""Corpus operators for training-data pipelines.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.  Each module holds one
operator with its general interface and the ``opN_*`` query that reduces its output to digest
columns; :mod:`datebook.llm.registry` lists the queries.
"""
