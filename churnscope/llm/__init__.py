"""Operators of a training-data pipeline: ten operators and their registered queries.

Nothing else in the library imports this subpackage. ``registry`` lists the
queries and their SQL; ``corpus_pipeline.py`` at the top of the repository
chains five of the operators.
"""
