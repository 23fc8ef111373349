"""Column expressions that the operators are built of."""
