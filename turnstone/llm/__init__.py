"""Operators of the training-data pipeline. Nothing outside this package imports it."""
