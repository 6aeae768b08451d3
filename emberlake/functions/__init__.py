"""Column expressions: scoring, text, time."""
