"""The catalogue of rules and the plans built from it."""
