"""plans of the curve engine."""
