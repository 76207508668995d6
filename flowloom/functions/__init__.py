"""Column expressions: addresses, names, numbers, verdicts."""
