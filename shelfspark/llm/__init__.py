"""Operators for large text and training-data tables. Nothing outside this subpackage imports it."""
