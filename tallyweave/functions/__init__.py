"""Scalar helpers: distribution functions, regular expressions, small formatters."""
