"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage; it can be deleted as a
whole.  Each ``opN`` module holds one operator with its general interface and
the thin query that applies it to the driver's tables.
"""
