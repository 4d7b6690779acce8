"""Exact deduplication by skew-safe combining.

Three combining steps, each of which groups by the *whole* normalised text and
not by its digest alone:

1. every input partition is deduplicated by itself (the map side of the first
   aggregation, so a text repeated in a partition leaves it once);
2. the partition winners merge within salted digest groups, so a text that
   fills a third of the table is spread over ``salts`` reducers;
3. the at most ``salts`` winners of each text merge globally.

Every row then meets its group's result; the rows of groups that hold more than
a thousandth of the table are dealt over several tasks there.

Defined results: null text counts as empty; equal texts are those identical
after lower-casing A-Z; the row with the largest id stays (null ids lose to any
other; if all are null, ``keep_id`` is null and every such row is kept). Rows
that repeat both id and text are one row written twice: each is reported kept.
An empty table gives an empty result. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm._rows import drop_rows, join_groups
from framewright.runtime import materialize


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string."""
    text = F.coalesce(text, F.lit(""))
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=_digest) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``digest`` maps the normalised text to the grouping key. It only routes
    rows: two texts with one digest stay two groups.
    """
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("body")).withColumn("key", digest(F.col("body")))
    local = rows.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("key", "salt", "body").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    # hash(key) alone also serves the count of texts per digest below, without another shuffle
    merged = salted.drop("salt").repartition("key").groupBy("key", "body").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    texts = F.count(F.lit(1)).over(Window.partitionBy("key"))
    groups = merged.withColumn("texts", texts)
    groups = groups.withColumn("body", F.when(F.col("texts") > 1, F.col("body")))
    groups = materialize(groups, "exact-groups")

    def out(joined: DataFrame) -> DataFrame:
        return joined.select(
            F.col("id").alias(id_col),
            F.col("keep").alias("keep_id"),
            F.col("n").alias("group_size"),
            F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )

    keyed = rows.withColumn("sha", F.sha2(F.col("body"), 256))
    total = groups.agg(F.sum("n")).first()[0] or 0
    single = groups.filter("texts = 1").drop("body", "texts")
    result = out(join_groups(keyed.drop("body"), single, ["key"], total))
    shared = groups.filter("texts > 1").drop("texts")
    if not shared.isEmpty():  # digests of several texts: settle those rows by content
        result = result.unionByName(out(join_groups(keyed, shared, ["key", "body"], total)))
    return result


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows that repeat both id and text once.

    Rows are told apart by id and text, null ids too, so a row shares the fate of
    no other text under its id.
    """
    verdict = materialize(exact_dedup(docs, id_col, text_col, **options), "exact-verdict")
    lost = verdict.filter(~F.col("kept")).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("mark"))
    repeated = not verdict.filter("kept").groupBy(id_col, "text_sha256").count().filter("count > 1").isEmpty()
    return drop_rows(docs, lost, repeated, id_col, F.sha2(ascii_lower(F.col(text_col)), 256))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM d
"""


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
