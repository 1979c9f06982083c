"""Streaming of barloom."""
