"""Scans, detectors, filters and reports as DataFrame transformations."""
