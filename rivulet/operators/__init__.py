"""Relational and statistical operators."""
