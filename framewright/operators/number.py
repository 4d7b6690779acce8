"""Rows numbered in an order without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.runtime import materialize, release


def _ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in ranges of the order (``__part``), each with its rows numbered (``__inner``)."""
    read = materialize(df, "unordered")  # finding the ranges reads it twice
    spread = read.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    spread = spread.withColumns({"__part": F.shiftrightunsigned("__at", 33), "__inner": F.col("__at").bitwiseAND((1 << 33) - 1)})
    spread = materialize(spread.drop("__at"), "ranged")
    release(read)
    return spread


def _shifts(spread: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each range, what the ranges before it add up to: a row a range."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy("__part").agg(*(c.alias(n) for n, c in sums.items()))
    return F.broadcast(totals.select("__part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums)))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: the position of the row in the order, from 0.

    Ranges of the order are numbered apart and shifted by the rows before them,
    of which there is one number for each range.
    """
    spread = _ranged(df, order)
    shifted = spread.join(_shifts(spread, {"__before": F.count(F.lit(1))}), "__part")
    return shifted.withColumn(name, F.col("__before") + F.col("__inner")).drop("__part", "__inner", "__before")


def running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str], name: str) -> DataFrame:
    """:func:`numbered`, with running sums besides: ``sums`` names each and the column it adds up."""
    spread = _ranged(df, order)
    inner = Window.partitionBy("__part").orderBy("__inner").rowsBetween(Window.unboundedPreceding, 0)
    shifts = _shifts(spread, {"__before": F.count(F.lit(1)), **{f"__{n}": F.sum(c) for n, c in sums.items()}})
    summed = spread.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()}).join(shifts, "__part")
    out = summed.withColumns({name: F.col("__before") + F.col("__inner"), **{n: F.col(n) + F.col(f"__{n}") for n in sums}})
    return out.drop("__part", "__inner", "__before", *(f"__{n}" for n in sums))
