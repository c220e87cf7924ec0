"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered ``opN_*`` queries and ``corpus_pipeline.py`` (repository top) the
pipeline made of them.
"""
