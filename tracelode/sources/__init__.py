"""Readers and writers of profile files."""
