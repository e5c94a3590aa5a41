"""functions of the curve engine."""
