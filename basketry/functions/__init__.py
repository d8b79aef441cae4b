"""Column expressions and shared relational building blocks."""
