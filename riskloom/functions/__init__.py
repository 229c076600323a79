"""Column expressions: text, patterns, scoring."""
