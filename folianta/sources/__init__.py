"""Readers, writers and materialised intermediate tables."""
