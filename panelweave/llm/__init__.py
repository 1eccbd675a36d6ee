"""Operators for large training-data tables; nothing outside this package imports it."""
