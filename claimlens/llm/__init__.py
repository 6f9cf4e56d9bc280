"""Operators for training-data pipelines on the ``documents``-like tables.

Each module holds one operator; ``queries`` registers one query per operator.
Text work runs in Arrow batches inside Spark tasks (``text`` and ``packed``
hold the shared array helpers); everything that compares documents with each
other goes through Spark shuffles keyed by content hashes.
"""
