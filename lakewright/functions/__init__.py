"""Column builders: plain Spark expressions, kept inside code generation."""
