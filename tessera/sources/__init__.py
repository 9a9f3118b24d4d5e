"""Readers, writers, caches and shared tables."""
