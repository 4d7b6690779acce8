"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. ``framewright.llm.registry`` lists
the queries and their SQL.
"""
