"""Column expressions; no user-defined functions."""
