"""Readers, writers and updates of tables."""
