"""Column and DataFrame builders used inside models."""
