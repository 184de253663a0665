"""Readers, writers and the binding of the star-schema tables."""
