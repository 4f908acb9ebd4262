"""Readers, writers and rule files."""
