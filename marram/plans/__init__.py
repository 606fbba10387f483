"""Composite pipelines and reports."""
