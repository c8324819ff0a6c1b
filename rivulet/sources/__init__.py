"""Readers and writers of network folders."""
