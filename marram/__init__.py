"""Catalogue quality, entity resolution and corpus preparation on Spark."""
