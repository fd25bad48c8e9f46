"""Column expressions and small reusable aggregates."""
