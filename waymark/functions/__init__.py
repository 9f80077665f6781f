"""Column functions and Arrow-backed scorers."""
