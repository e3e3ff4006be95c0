"""Readers and writers of the screening tables."""
