"""Readers of page and dump formats."""
