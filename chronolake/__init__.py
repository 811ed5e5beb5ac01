"""Activity-memory analytics as plain Spark DataFrames."""
