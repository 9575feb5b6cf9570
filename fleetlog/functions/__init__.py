"""Column expressions: rounding, text clean-up, typing."""
