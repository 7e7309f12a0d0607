"""Relational, text, index, ranking, graph, vector and quality operators."""
