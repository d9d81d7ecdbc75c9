"""Extracting, transforming and checking localisable text on Spark."""
