"""Relational operators over the store: point-in-time reads, universes, returns, identity, costs, signals, reports."""
