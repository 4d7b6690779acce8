"""Registered queries, their SQL and the workflow."""
