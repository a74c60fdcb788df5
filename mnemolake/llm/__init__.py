"""Operators for training-data pipelines, with their registered queries."""
