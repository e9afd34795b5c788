"""Operators for training-data pipelines at scale; nothing else in the library imports this subpackage."""
