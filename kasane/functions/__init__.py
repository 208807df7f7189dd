"""Column builders: pure expressions, no Python in the hot path."""
