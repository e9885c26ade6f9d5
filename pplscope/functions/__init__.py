"""Column functions: text, arrays, vectors. Every one is a native Spark expression."""
