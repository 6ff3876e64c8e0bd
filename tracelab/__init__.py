"""Analysis of ordered event traces on Spark."""
