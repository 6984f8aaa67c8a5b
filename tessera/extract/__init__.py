"""Fact extraction from source text."""
