"""Column expressions, word lists and small numeric helpers."""
