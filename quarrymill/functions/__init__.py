"""Column functions and code-structure functions."""
