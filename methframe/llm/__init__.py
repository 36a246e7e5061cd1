"""Operators for text and model training data; nothing outside this package imports it."""
