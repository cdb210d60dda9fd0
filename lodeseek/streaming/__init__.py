"""Incremental chunking of arriving files."""
