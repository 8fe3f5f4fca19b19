"""Operators on the texts of training data; nothing outside this package imports it."""
