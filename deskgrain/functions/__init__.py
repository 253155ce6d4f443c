"""Column helpers and small dimension tables."""
