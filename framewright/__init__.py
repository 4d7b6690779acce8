"""Spark-first analytics for wireless probe fingerprints.

Sub-packages: ``sources`` (captures, CSV, Parquet), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame steps), ``plans`` (whole
workflows and the registered queries) and ``streaming``.
"""

__version__ = "0.1.0"
