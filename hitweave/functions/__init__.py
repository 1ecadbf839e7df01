"""Column expressions (scalar functions)."""
