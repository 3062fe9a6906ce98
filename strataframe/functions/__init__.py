"""Column expressions: codes, text rules, labels and coercions."""
