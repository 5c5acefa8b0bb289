"""Column expressions: text repair, number parsing, labels and formats."""
