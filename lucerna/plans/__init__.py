"""Registered queries, each a complete plan over the input tables."""
