"""Column catalog, quality scan, tests and models as DataFrame operators."""
