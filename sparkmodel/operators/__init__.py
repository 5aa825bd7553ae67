"""Relational operators: writers, audits, diffs, interval algebra in DataFrame form."""
