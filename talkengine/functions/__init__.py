"""Column expressions: JVM-side scalars over text, arrays and scores. None of them reads data."""
