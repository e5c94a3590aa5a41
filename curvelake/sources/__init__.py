"""sources of the curve engine."""
