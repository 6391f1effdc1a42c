"""Column functions on text and tokens."""
