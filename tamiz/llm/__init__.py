"""Operators for training data from text; nothing outside this package imports it."""
