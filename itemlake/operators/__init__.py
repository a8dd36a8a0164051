"""Operators over items, each a function from DataFrame to DataFrame."""
