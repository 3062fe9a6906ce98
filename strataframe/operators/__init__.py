"""Relational, statistical and model operators."""
