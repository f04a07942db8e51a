"""Registered queries over the given tables, and an independent SQL form of each."""
