"""Column functions and numerics."""
