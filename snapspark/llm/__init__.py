"""Operators of a training-data pipeline: one module for each, and `queries` that registers them."""
