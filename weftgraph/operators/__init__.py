"""Relational operators on graphs, text, vectors and extraction records."""
