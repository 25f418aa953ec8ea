"""Column expressions (no jobs, no UDFs)."""
