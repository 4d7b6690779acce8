"""Bursts over arriving captures."""
