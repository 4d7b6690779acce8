"""Cleaning, padding and concatenation of the binary table; bit-mask filters; bursts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.bits import u_to_zero
from framewright.operators.number import numbered

# The excluded sender, dropped columns and the least width of vendor tags.
EXCLUDED_MAC = "00:0f:00:6a:68:8b"
DROPPED = ["frame_check_seq", "len_dsss", "ssid", "len_ssid", "len_sup_rates", "len_ext_sup_rates", "len_vht_cap", "len_ext_tags", "supported_rates", "ext_sup_rates", "vht_cap", "ext_tags", "mac"]
VENDOR_WIDTH = 1336
CONCATENATED = ["dsss_parameter", "len_ht_cap", "ht_cap", "len_ext_cap", "ext_cap", "len_vst", "vst"]


def clean(df: DataFrame, columns: Iterable[str] = ("mac", "MAC Address"), excluded: str = EXCLUDED_MAC) -> DataFrame:
    """Without the rows of one sender; rows without a sender stay."""
    for c in columns:
        if c in df.columns:
            df = df.filter(~F.col(c).eqNullSafe(excluded))
    return df


def with_row_id(df: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 0 in a given order (``row_id``)."""
    return numbered(df, order, "row_id")


def padded(c: Column, width: Column | int, symbol: str) -> Column:
    """Right-padded, never cut."""
    width = F.lit(width) if isinstance(width, int) else width
    text = F.coalesce(c, F.lit(""))
    return F.rpad(text, F.greatest(width, F.length(text)), F.lit(symbol))


def pad_columns(df: DataFrame, symbol: str = "0", exclude: Sequence[str] = (), length: int | None = None) -> DataFrame:
    """Every column padded to its longest value, or ``length`` if that is more; a null counts as three long."""
    columns = [c for c in df.columns if c not in exclude]
    longest = df.agg(*(F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("nan")))).alias(c) for c in columns)).first()
    widths = {c: max(longest[c] or 0, length or 0) for c in columns}
    return df.withColumns({c: padded(F.col(c).cast("string"), widths[c], symbol) for c in columns})


def concatenate(binary: DataFrame, key: Sequence[str] = ("row_id",), vendor_width: int = VENDOR_WIDTH) -> DataFrame:
    """key, label, concatenated: one text of ``0``, ``1`` and ``U`` of equal length for every probe."""
    binary = clean(binary)
    missing = lambda c: F.when(F.col(c).isin("nan", ""), F.lit(None)).otherwise(F.col(c))
    longest = binary.agg(F.max(F.length(missing("dsss_parameter"))).alias("d"), *(F.max(F.length(F.coalesce(missing(c), F.lit("nan")))).alias(c) for c in CONCATENATED[1:])).first()
    dsss = F.coalesce(missing("dsss_parameter"), F.lit("0"))
    parts = [F.lpad(dsss, F.greatest(F.lit(longest["d"] or 1), F.length(dsss)), F.lit("0"))]
    for c in CONCATENATED[1:]:
        width = max(longest[c] or 0, vendor_width if c == "vst" else 0)
        parts.append(padded(missing(c), width, "U"))
    return binary.select(*key, "label", F.concat(*parts).alias("concatenated"))


def zero_twin(df: DataFrame) -> DataFrame:
    """The same rows with unknown symbols as zero."""
    return df.withColumn("concatenated", u_to_zero(F.col("concatenated")))


def bitmask_filters(spark: SparkSession, length: int, blocks: Sequence[int] = (8, 16)) -> DataFrame:
    """filter_id, start, block, kind, Bitmask: aligned blocks of ``N1``, ``1N`` and ``11``."""
    out = None
    for order, b in enumerate(blocks):
        starts = spark.range(0, max(0, length // b)).select(F.lit(order).alias("o"), F.lit(b).alias("block"), (F.col("id") * b).cast("int").alias("start"))
        out = starts if out is None else out.unionByName(starts)
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(a).alias("a"), F.lit(z).alias("z")) for i, (a, z) in enumerate((("N", "1"), ("1", "N"), ("1", "1"))))))
    half = (F.col("block") / 2).cast("int")
    mask = F.concat(F.repeat(F.lit("0"), F.col("start")), F.repeat(F.col("k.a"), half), F.repeat(F.col("k.z"), half), F.repeat(F.lit("0"), F.lit(length) - F.col("start") - F.col("block")))
    before = sum((F.when(F.col("o") > i, 3 * (length // b)).otherwise(0) for i, b in enumerate(blocks)), F.lit(0))
    number = (before + 3 * (F.col("start") / F.col("block")).cast("int") + F.col("k.kind")).cast("int")
    return out.withColumn("k", kinds).select(number.alias("filter_id"), "start", "block", F.col("k.kind").alias("kind"), mask.alias("Bitmask"))


def filter_label(mask: Column) -> Column:
    """``0[a] ooxx 0[b]``: zeros before, the pattern with 1 as x and N as o, zeros after."""
    body = F.regexp_extract(mask, "^0*(.*?)0*$", 1)
    before = F.length(F.regexp_extract(mask, "^(0*)", 1))
    after = F.length(mask) - before - F.length(body)
    some = F.concat(F.lit("0["), before.cast("string"), F.lit("] "), F.translate(body, "1N", "xo"), F.lit(" 0["), after.cast("string"), F.lit("]"))
    return F.when(body == "", F.concat(F.lit("0["), F.length(mask).cast("string"), F.lit("]"))).otherwise(some)


def bursts(df: DataFrame, group: str = "label", order: Sequence[str] = ("row_id",), value: str = "dsss") -> DataFrame:
    """``burst_id``: within a group a new burst begins where the value drops."""
    w = Window.partitionBy(group).orderBy(*order)
    drop = F.when(F.col(value) < F.lag(value).over(w), 1).otherwise(0)
    return df.withColumn("__drop", drop).withColumn("burst_id", F.sum("__drop").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__drop")


def binary_number(bits: Column) -> Column:
    """Bit text as a number; missing counts as 0."""
    return F.conv(F.coalesce(F.when(bits.isin("nan", ""), F.lit(None)).otherwise(bits), F.lit("0")), 2, 10).cast("long")


def default_label(df: DataFrame, label: str = "label", row_id: str = "row_id") -> DataFrame:
    """The row number as label where there is none."""
    known = F.col(label) if label in df.columns else F.lit(None)
    return df.withColumn(label, F.coalesce(known, F.col(row_id).cast("string")))


def device_distribution(df: DataFrame) -> DataFrame:
    """label, n_rows, n_distinct, in order of the label: counted by text first, so a large label is no task of its own."""
    texts = df.groupBy("label", "concatenated").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("label").agg(F.sum("n").alias("n_rows"), F.count("concatenated").alias("n_distinct")).orderBy("label")


def non_randomizing(df: DataFrame, label: str = "label", mac: str = "mac") -> DataFrame:
    """Labels with exactly one sender address."""
    return df.groupBy(label).agg(F.countDistinct(mac).alias("n")).filter("n = 1").select(label)


def length_summary(df: DataFrame) -> DataFrame:
    """Longest and mean length of the concatenated texts."""
    return df.agg(F.max(F.length("concatenated")).alias("max_length"), F.avg(F.length("concatenated")).alias("mean_length"))
