"""Operators for preparing text and media as training data. Nothing outside this subpackage imports it."""
