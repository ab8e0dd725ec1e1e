"""Column expressions: null-aware arithmetic, row-wise statistics, text, dates."""
