"""operators of the curve engine."""
