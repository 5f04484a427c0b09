"""factloom: evidence-first knowledge analytics as plain Spark DataFrames."""

__version__ = "0.1.0"
