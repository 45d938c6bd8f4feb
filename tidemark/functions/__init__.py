"""Column expressions. Everything here is JVM-side; there are no Python UDFs."""
