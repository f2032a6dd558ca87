"""Corpus operators for training data; nothing outside this subpackage imports it."""
