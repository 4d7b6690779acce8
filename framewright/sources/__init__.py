"""Captures and tables."""
