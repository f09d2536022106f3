"""Column expressions: text, scoring, intervals."""
