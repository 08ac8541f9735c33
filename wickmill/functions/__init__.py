"""Column expressions. All of them stay inside the JVM; none is a Python UDF."""
