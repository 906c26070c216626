"""Column functions: geometry, text, keys and checks."""
