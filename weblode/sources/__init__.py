"""Scans: stored bytes and text to tables."""
