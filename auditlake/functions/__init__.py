"""Column expressions: text, rules, edits, review and the worker functions."""
