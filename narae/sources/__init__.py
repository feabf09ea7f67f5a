"""Readers, prose ranges of source kinds, and tokens."""
