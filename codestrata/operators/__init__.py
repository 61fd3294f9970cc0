"""Relational operators over source-intelligence tables."""
