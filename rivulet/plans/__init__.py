"""Registered queries over the synthetic network."""
