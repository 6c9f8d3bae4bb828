"""Column expressions: everything here maps Columns to Columns and stays JVM-side."""
