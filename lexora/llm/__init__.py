"""Operators for building training corpora at scale."""
