"""Relational, ranking, matching and evaluation operators."""
