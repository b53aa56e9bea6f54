"""Operators for building training data out of document corpora."""
