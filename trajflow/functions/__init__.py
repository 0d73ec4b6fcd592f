"""Column expressions and the two vectorised text functions."""
