"""Operators on tables of sequences, k-mers and intervals."""
