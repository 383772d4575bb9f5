"""Operators for building training corpora; nothing else in the library imports this package."""
