"""Column functions: text, time and arithmetic rules as Spark expressions."""
