"""Column expressions and the few vectorised functions Spark does not have."""
