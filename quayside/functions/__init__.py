"""Column functions: each takes and returns a Column, all built from Spark built-ins."""
