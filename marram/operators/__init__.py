"""Relational operators over catalogue tables."""
