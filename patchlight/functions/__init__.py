"""Column expressions: text in, column out, all on the JVM side."""
