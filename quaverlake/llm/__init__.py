"""Operators for large training-data pipelines; each module documents its own contract."""
