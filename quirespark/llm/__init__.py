"""Operators for training-data corpora. Nothing else in the package imports this subpackage."""
