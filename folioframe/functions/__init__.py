"""Column functions: text, geometry, numerals."""
