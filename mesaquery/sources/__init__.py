"""Readers and writers for record files."""
