"""Column expressions for names, numbers and projections."""
