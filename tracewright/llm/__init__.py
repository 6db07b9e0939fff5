"""Operators of a training-data pipeline.  Nothing outside imports this package."""
