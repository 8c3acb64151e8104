"""Column helpers and ordered-data helpers."""
