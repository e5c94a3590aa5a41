"""streaming of the curve engine."""
