"""Operators for large training-data work; nothing outside this subpackage imports it."""
