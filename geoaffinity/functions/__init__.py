"""Column expressions: ratios, the Student-t tail and number formats."""
