"""Readers, writers and the adapters onto the test tables."""
