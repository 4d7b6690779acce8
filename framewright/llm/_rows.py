"""Joins of every row with what was found for its group, and removal of single rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.runtime import materialize

HOT_SHARE, SALTS = 1000, 64
FEW = 100_000  # rows of an id and a digest, some 10 MB


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``groups``, one row a key with its row count ``n``.

    Groups over 1/``HOT_SHARE`` of the ``total`` rows are at most ``HOT_SHARE``,
    so their keys are broadcast; their rows are dealt over ``SALTS`` tasks.
    """
    keys = list(keys)
    is_hot = F.col("n") * HOT_SHARE > F.lit(total)
    hot = groups.filter(is_hot).select(*keys, F.lit(True).alias("__hot"))
    if hot.isEmpty():
        return rows.join(groups, keys)
    salt = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return salted.join(groups.withColumn("__salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0))))), [*keys, "__salt"]).drop("__salt")


def mark_of(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text)


def drop_rows(docs: DataFrame, lost: DataFrame, repeated: bool, id_col: str, mark: Column) -> DataFrame:
    """``docs`` without the rows that ``lost`` (id, mark) names, null ids too; if ``repeated``, rows equal in both once.

    Up to ``FEW`` lost rows are broadcast, so the texts stay where they are; more meet them in a join.
    """
    lost = materialize(lost.select(F.col("id").alias("__lost_id"), F.col("mark").alias("__lost_mark")).distinct(), "lost")
    lost = F.broadcast(lost) if lost.count() <= FEW else lost
    marked = docs.withColumn("__row_mark", mark)
    kept = marked.join(lost, (F.col("__row_mark") == F.col("__lost_mark")) & F.col(id_col).eqNullSafe(F.col("__lost_id")), "left_anti")
    return (kept.dropDuplicates([id_col, "__row_mark"]) if repeated else kept).drop("__row_mark")
