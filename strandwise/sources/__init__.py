"""Readers and writers: sequence files, windows, archive manifests, stored results."""
