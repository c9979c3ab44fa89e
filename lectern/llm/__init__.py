"""Operators for large training-text corpora, each usable on its own."""
