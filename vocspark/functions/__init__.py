"""Column expressions and row-ordering helpers."""
