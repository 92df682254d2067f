"""Where files, settings and changed lines come from."""
