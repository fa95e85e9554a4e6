"""Column and calendar functions, and metrics."""
