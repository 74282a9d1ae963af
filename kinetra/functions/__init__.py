"""Column expressions and the few special functions that Spark lacks."""
