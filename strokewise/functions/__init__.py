"""Column functions, and table functions for SQL."""
