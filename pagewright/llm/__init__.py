"""Operators of large training-data pipelines; nothing else in the library imports them."""
