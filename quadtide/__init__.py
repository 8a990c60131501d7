"""Windowed analytics over annotated, uncertain statements as plain Spark DataFrame operators."""
