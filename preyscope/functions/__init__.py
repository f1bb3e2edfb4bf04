"""Column expressions and small table functions."""
