"""Operators for preparing language-model training data.

Nothing else in :mod:`gleaner` imports this subpackage; it stands on PySpark,
numpy and pyarrow alone, so it can be removed without touching the rest.
"""
