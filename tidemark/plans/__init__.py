"""Stored layouts, write plans and the staging of the domain tables."""
