"""Readers, writers and normalisers."""
