"""Refresh as snapshots land."""
