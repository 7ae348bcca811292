"""Readers of archive files and checks at the door."""
