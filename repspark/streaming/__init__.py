"""Contigs that arrive as a stream."""
