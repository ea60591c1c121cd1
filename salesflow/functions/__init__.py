"""Column expressions and rules."""
