"""Operators for training-data problems on language; nothing outside this package imports it."""
