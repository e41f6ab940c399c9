"""Column builders and small row functions."""
