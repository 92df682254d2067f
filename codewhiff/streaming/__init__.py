"""Scans of streams."""
