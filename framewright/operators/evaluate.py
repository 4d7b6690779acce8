"""Pairs, distances, ROC curves and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.bits import ascii_sum
from framewright.functions.distances import manhattan
from framewright.operators.number import running
from framewright.runtime import materialize

FEW = 1_000_000  # rows of a few numbers that one task may order


def pair_texts(pairs: DataFrame, probes: DataFrame, columns: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """Pairs with the columns of both sides, named ``<column> 1`` and ``<column> 2``."""
    for side in (1, 2):
        part = probes.select(F.col(id_col).alias(f"item{side}"), *(F.col(c).alias(f"{c} {side}") for c in columns))
        pairs = pairs.join(part, f"item{side}")
    return pairs


def items_of(pairs: DataFrame) -> DataFrame:
    """item: the distinct items of both sides."""
    return pairs.select(F.col("item1").alias("item")).union(pairs.select("item2")).distinct()


def once_per_text(df: DataFrame, text: str, name: str, value) -> DataFrame:
    """``name`` for every row, computed once for each distinct text."""
    done = df.select(text).distinct().withColumn(name, value)
    return df.join(done, text)


def sums_of(df: DataFrame, columns: Sequence[str], strip: str = "") -> DataFrame:
    """Hex columns as byte sums."""
    return df.withColumns({c: ascii_sum(F.col(c), strip) for c in columns})


def min_max(df: DataFrame, columns: Sequence[str], *groups: str) -> DataFrame:
    """Columns scaled to [0, 1]; constant columns give 0, nulls stay."""
    w = None if not groups else Window.partitionBy(*groups)
    if w is None:
        ends = df.agg(*(F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)), *(F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(columns))).first()
        low, high = ([F.lit(ends[f"{x}{i}"]) for i in range(len(columns))] for x in ("lo", "hi"))
    else:
        low, high = ([f(c).over(w).cast("double") for c in columns] for f in (F.min, F.max))
    scaled = {c: F.when(F.col(c).isNotNull(), F.when(h > lo, (F.col(c) - lo) / (h - lo)).otherwise(0.0)) for c, lo, h in zip(columns, low, high, strict=True)}
    return df.withColumns(scaled)


def byte_sum_features(df: DataFrame, columns: Sequence[str], norm: bool = True, label: str = "Label", strip: str = "") -> DataFrame:
    """Byte sums, scaled if ``norm``, nulls as 0."""
    summed = sums_of(df, columns, strip)
    scaled = min_max(summed, columns) if norm else summed
    return scaled.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns), label, *(c for c in ("row_id",) if c in df.columns))


def pair_manhattan(pairs: DataFrame, hex_table: DataFrame, columns: Sequence[str], joint: bool = False, strip: str = "") -> DataFrame:
    """Pairs with ``d``: distance of scaled byte sums; each side is scaled over the pairs, or both together."""
    pairs = pairs.distinct()
    met = pair_texts(pairs, sums_of(hex_table, columns, strip), columns)
    names = [f"{c} {s}" for s in (1, 2) for c in columns]
    if joint:
        low = [F.min(F.least(f"{c} 1", f"{c} 2")).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)]
        high = [F.max(F.greatest(f"{c} 1", f"{c} 2")).cast("double").alias(f"hi{i}") for i, c in enumerate(columns)]
        ends, scaled = met.agg(*low, *high).first(), {}
        for i, c in enumerate(columns):
            start, width = ends[f"lo{i}"] or 0.0, (ends[f"hi{i}"] or 0.0) - (ends[f"lo{i}"] or 0.0)
            for s in (1, 2):
                scaled[f"{c} {s}"] = (F.col(f"{c} {s}") - F.lit(start)) / F.lit(width) if width > 0 else F.lit(0.0)
        met = met.withColumns(scaled)
    else:
        met = min_max(met, names)
    return met.withColumn("d", manhattan([(F.col(f"{c} 1"), F.col(f"{c} 2")) for c in columns]))


def roc(df: DataFrame, d: str = "d", y: str = "equality", groups: Sequence[str] = (), drop_intermediate: bool = True, few: int = FEW) -> DataFrame:
    """groups, d, tp, fp, fpr, tpr, tau: the curve of -d against y = 1, without its start at (0, 0).

    Points whose step equals the step after it are dropped, as the usual curve
    does. With one class only the curve is empty. A curve of more than ``few``
    distinct distances is added up in ranges, so it need not fit one task; a
    curve for each of several groups is a task each.
    """
    some = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    counted = df.filter(F.col(d).isNotNull()).groupBy(*groups, F.col(d).alias("d")).agg(some(F.col(y) == 1, "p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("q"))
    counted = materialize(counted, "roc")
    if groups or counted.count() <= few:
        by = Window.partitionBy(*groups)
        order = by.orderBy("d")
        run = order.rowsBetween(Window.unboundedPreceding, 0)
        points = counted.withColumns({"tp": F.sum("p").over(run), "fp": F.sum("q").over(run), "all_p": F.sum("p").over(by), "all_q": F.sum("q").over(by)})
        points = points.withColumns({"first": F.lag("d").over(order).isNull(), "p2": F.lead("p").over(order), "q2": F.lead("q").over(order)})
    else:
        points = materialize(running(counted, ["d"], {"tp": "p", "fp": "q"}, "at"), "roc-points")
        after = points.select((F.col("at") - 1).alias("at"), F.col("p").alias("p2"), F.col("q").alias("q2"))
        total = counted.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q")).first()
        points = points.join(after, "at", "left").withColumns({"first": F.col("at") == 0, "all_p": F.lit(total.all_p), "all_q": F.lit(total.all_q)})
    points = points.filter("all_p > 0 and all_q > 0")
    if drop_intermediate:
        points = points.filter(F.col("first") | F.col("p2").isNull() | (F.col("p") != F.col("p2")) | (F.col("q") != F.col("q2")))
    return points.select(*groups, "d", "tp", "fp", (F.col("fp") / F.col("all_q")).alias("fpr"), (F.col("tp") / F.col("all_p")).alias("tpr"), F.col("d").cast("double").alias("tau"))


def best_tau(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """groups, best_tau, tpr, fpr, dist: the point nearest to (0, 1), the first of equals."""
    dist = F.sqrt(F.pow("fpr", 2) + F.pow(1 - F.col("tpr"), 2))
    best = F.min_by(F.struct("tau", "tpr", "fpr", "dist"), F.struct(F.round("dist", 12), "d")).alias("b")
    found = curve.withColumn("dist", dist).groupBy(*groups).agg(best) if groups else curve.withColumn("dist", dist).agg(best)
    return found.select(*groups, F.col("b.tau").alias("best_tau"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"), F.col("b.dist").alias("dist"))


def auc_trapezoid(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the saved points as they are."""
    order = Window.partitionBy(*groups).orderBy("fpr", "tpr", "tau")
    area = (F.col("fpr") - F.lag("fpr").over(order)) * (F.col("tpr") + F.lag("tpr").over(order)) / 2
    summed = curve.withColumn("a", area)
    return (summed.groupBy(*groups) if groups else summed).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))


def resampled(curve: DataFrame, points: int = 100, groups: Sequence[str] = ()) -> DataFrame:
    """groups, k, fpr, tpr: highest tpr of each fpr, ends added, interpolated at even steps."""
    best = curve.groupBy(*groups, "fpr").agg(F.max("tpr").alias("tpr"))
    ends = curve.select(*groups).distinct() if groups else curve.sparkSession.range(1)
    ends = ends.select(*groups, F.explode(F.array(*(F.struct(F.lit(v).alias("fpr"), F.lit(v).alias("tpr")) for v in (0.0, 1.0)))).alias("e")).select(*groups, "e.*")
    joined = best.unionByName(ends).groupBy(*groups, "fpr").agg(F.max("tpr").alias("tpr"))
    order = Window.partitionBy(*groups).orderBy("fpr")
    pieces = joined.withColumns({"f2": F.lead("fpr").over(order), "t2": F.lead("tpr").over(order)})
    n = points - 1
    low = F.ceil(F.round(F.col("fpr") * n, 9)).cast("int")
    high = F.coalesce(F.ceil(F.round(F.col("f2") * n, 9)).cast("int") - 1, F.lit(n))
    ks = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)")))
    at = pieces.withColumn("k", ks)
    x = F.col("k") / F.lit(float(n))
    line = F.when(F.col("f2").isNull(), F.col("tpr")).otherwise(F.col("tpr") + (F.col("t2") - F.col("tpr")) * (x - F.col("fpr")) / (F.col("f2") - F.col("fpr")))
    return at.select(*groups, "k", x.alias("fpr"), line.alias("tpr"))


def auc_interpolated(curve: DataFrame, points: int = 100, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the resampled curve."""
    return auc_trapezoid(resampled(curve, points, groups).withColumn("tau", F.col("k").cast("double")), groups)


def series_summary(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation and quartiles of a series, for lines with bands and for boxes.

    A series has a value for each combination and cycle, thousands at most, so its quartiles are exact.
    """
    return df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q3"))
