"""Column functions for source text."""
