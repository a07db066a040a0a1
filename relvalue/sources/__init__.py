"""Readers and writers of the feeds and results."""
