"""Operators for building training corpora."""
