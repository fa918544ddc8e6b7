"""Operators for preparing large training corpora and embedding tables."""
