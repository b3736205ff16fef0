"""Column functions, all built from Spark's own."""
