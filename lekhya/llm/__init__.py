"""Operators for training-data pipelines over text and vectors. Nothing else in the library imports this subpackage."""
