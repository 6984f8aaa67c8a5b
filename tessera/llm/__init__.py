"""Operators for preparing large training corpora. Nothing outside this package imports it."""
