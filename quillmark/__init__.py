"""Read-model analytics expressed with PySpark DataFrames and SQL."""
