"""Operators, one module per family; each is a function from DataFrame to DataFrame."""
