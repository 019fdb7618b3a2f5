"""Corpus operators for training data and their queries."""
