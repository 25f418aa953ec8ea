"""Process-history analytics on Spark: every operator takes and returns a DataFrame."""
