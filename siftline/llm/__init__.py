"""Operators of a training-data pipeline.  Nothing else in siftline imports this package."""
