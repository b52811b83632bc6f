"""Operators of a training-data pipeline. Nothing else in ladle imports this subpackage."""
