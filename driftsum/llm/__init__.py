"""Operators for large training-data pipelines. Nothing else in driftsum imports this subpackage."""
