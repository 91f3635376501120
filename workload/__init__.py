"""Registered queries over the given tables, with independent SQL for each."""
