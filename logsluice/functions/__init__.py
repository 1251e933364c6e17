"""Column functions: patterns, typing, time, extraction, spans."""
