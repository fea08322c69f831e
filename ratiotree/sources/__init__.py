"""Readers, writers and the folder for intermediate tables."""
