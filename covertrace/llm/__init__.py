"""Operators for building text corpora from collected coverage."""
