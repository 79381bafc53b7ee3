"""Column expressions: everything here maps columns to columns, without touching a DataFrame."""
