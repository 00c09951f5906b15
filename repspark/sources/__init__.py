"""Readers and writers of repertoire file formats."""
