"""Relational, graph, temporal and rule operators over the catalogue tables."""
