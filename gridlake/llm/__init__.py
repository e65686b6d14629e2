"""Operators for training-data pipelines; nothing else in gridlake imports this subpackage."""
