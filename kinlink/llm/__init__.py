"""Operators of a training-data pipeline; nothing else in kinlink imports this subpackage."""
