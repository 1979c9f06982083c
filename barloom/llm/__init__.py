"""Operators for training-data pipelines; nothing else in barloom imports them."""
