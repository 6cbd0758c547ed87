"""Column functions: coercion, text, display and vectors."""
