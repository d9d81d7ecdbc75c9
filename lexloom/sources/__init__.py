"""Scans that turn documents of several formats into text entries."""
