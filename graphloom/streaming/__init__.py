"""Extraction as a stream."""
