"""Operators on text corpora for training-data work. Nothing outside this package imports it."""
