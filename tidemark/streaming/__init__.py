"""Incremental arrival of archive files."""
