"""Operators for large text and matching pipelines; nothing else in the library imports this package."""
