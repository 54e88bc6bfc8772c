"""Structural queries over documents, as DataFrame plans: parse once to a table of nodes, match with joins and filters."""
