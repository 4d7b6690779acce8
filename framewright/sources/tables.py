"""CSV and Parquet tables, and boosted-model logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], recursive: bool = True, one_per_name: bool = False) -> DataFrame:
    """All columns as text by an explicit schema, with ``file`` and ``row_id``.

    Types are never inferred: hex such as ``00000080`` stays as it is.
    ``row_id`` follows path and position. ``one_per_name`` keeps, of files with
    one name, the last path only.
    """
    from framewright.operators.prep import with_row_id

    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.csv")
    rows = (reader.option("recursiveFileLookup", True) if recursive else reader).csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__seq"))
    if one_per_name:
        # a row a file: the rows themselves are not shuffled
        name = F.regexp_extract("file", "([^/]+)$", 1)
        last = rows.select("file").distinct().groupBy(name).agg(F.max("file").alias("file")).select("file")
        rows = rows.join(last, "file", "left_semi").select(*rows.columns)
    return with_row_id(rows, "file", "__block", "__seq").drop("__block", "__seq")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one with the schema where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(where) else spark.createDataFrame([], schema)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end here."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, replacing what is there."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, label: str | None = None) -> None:
    """CSV with a header, a folder for each label if one is named."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(label) if label else writer).csv(path)


def read_model_log(spark: SparkSession, path: str) -> DataFrame:
    """round, filter, threshold, min_error, confidence from a text log; a round ends at its confidence line.

    A log is a few lines a round, in one file.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    value = lambda key: F.when(F.lower("value").contains(key), F.regexp_extract("value", r":\s*(\S.*?)\s*$", 1))
    ends = F.when(F.lower("value").contains("confidence"), 1).otherwise(0)
    order = Window.orderBy("at")
    number = F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = lines.select((number + 1).cast("int").alias("round"), value("filter").alias("filter"), value("threshold").alias("threshold"), value("error").alias("min_error"), value("confidence").alias("confidence"))
    first = lambda c: F.max(c).alias(c)
    whole = rounds.groupBy("round").agg(*map(first, ("filter", "threshold", "min_error", "confidence"))).filter("confidence is not null")
    return whole.select("round", "filter", F.col("threshold").try_cast("int").alias("threshold"), F.col("min_error").try_cast("double").alias("min_error"), F.col("confidence").try_cast("double").alias("confidence"))
