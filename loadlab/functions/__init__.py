"""Column functions: one row in, one value out, all built from Spark built-ins."""
