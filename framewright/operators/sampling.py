"""Reproducible sampling: every choice is an order of hashed ids, the same on any cluster."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.number import numbered
from framewright.runtime import materialize


def order_key(seed: int, *parts: Column | str) -> Column:
    """Text that orders rows at random but always alike."""
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))


def ratio_sample(rows: DataFrame, draws: DataFrame, seed: int = 42) -> DataFrame:
    """draw, label, row_id, pos: ``n`` rows of a label for each draw, in the ratio of its values.

    ``rows`` has row_id, label, value; ``draws`` has draw, label, n. Largest
    remainders settle rounding (ties by value). The rows are put in one order
    (label, value, hash of the id) once; a draw takes as many rows of a value as
    it needs from there on where its own hash points, round to the first, or,
    where the value has too few, hashed choices with repetition. So the picks,
    whose number the draws set, meet rows by position, whatever the share of a
    value. ``pos`` numbers the rows of a draw from 1 in hashed order.
    """
    rows = rows.withColumn("value", F.coalesce("value", F.lit("∅")))
    placed = materialize(numbered(rows, ["label", "value", order_key(seed, "row_id"), "row_id"], "at"), "sample-order")
    counts = placed.groupBy("label", "value").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first"))
    counts = materialize(counts, "sample-counts")
    totals = counts.groupBy("label").agg(F.sum("m").alias("total"))
    share = draws.join(totals, "label").join(counts, "label")
    exact = F.col("m") * F.col("n")
    share = share.withColumns({"k": F.floor(exact / F.col("total")).cast("long"), "left": exact % F.col("total")})
    per_draw = Window.partitionBy("draw", "label")
    share = share.withColumn("missing", F.col("n") - F.sum("k").over(per_draw))
    rank = F.row_number().over(per_draw.orderBy(F.desc("left"), "value"))
    share = share.withColumn("k", F.col("k") + F.when(rank <= F.col("missing"), 1).otherwise(0)).filter("k > 0")
    hashed = lambda *parts: F.conv(F.substring(order_key(seed, *parts), 1, 8), 16, 10).cast("long")
    picks = share.select("draw", "label", "value", "m", "first", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i"))
    turn = F.when(F.col("k") <= F.col("m"), hashed("draw", "label", "value") + F.col("i")).otherwise(hashed("draw", "label", "value", "i"))
    copy = F.when(F.col("k") <= F.col("m"), 0).otherwise(F.col("i")).cast("long")
    picks = picks.select("draw", (F.col("first") + turn % F.col("m")).alias("at"), copy.alias("copy"))
    chosen = picks.join(placed.select("at", "label", "row_id"), "at").select("draw", "label", "row_id", "copy")
    pos = F.row_number().over(Window.partitionBy("draw", "label").orderBy(order_key(seed, "draw", "row_id", "copy"), "row_id", "copy"))
    return chosen.withColumn("pos", pos)


def _rows(df: DataFrame, label: str, value: str, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("row_id"), F.col(label).alias("label"), F.col(value).alias("value"))


def balanced_resample(df: DataFrame, n_per_label: int = 500, seed: int = 42, label: str = "label", value: str = "concatenated", id_col: str = "row_id") -> DataFrame:
    """label, row_id, pos: exactly ``n_per_label`` rows of each label in the ratio of its values."""
    rows = _rows(df, label, value, id_col)
    draws = rows.select("label").distinct().select(F.lit("all").alias("draw"), "label", F.lit(n_per_label).cast("long").alias("n"))
    return ratio_sample(rows, draws, seed).select("label", "row_id", "pos")


def propagate(sampled: DataFrame, other: DataFrame, id_col: str = "row_id") -> DataFrame:
    """The rows of another view of the same probes, as often as they were sampled."""
    if sampled.join(other.select(id_col), id_col, "left_anti").limit(1).count():
        raise ValueError("the two views do not have the same rows")
    return sampled.join(other, id_col)


def balanced_pairs(df: DataFrame, per_label: int = 1000, seed: int = 42, label: str = "label", value: str = "concatenated", id_col: str = "row_id") -> DataFrame:
    """item1, item2, device1, device2, equality: as many pairs within as across labels, for each label.

    Partners of the pairs across labels get even shares; the remainder goes to
    partners in hashed order.
    """
    rows = _rows(df, label, value, id_col)
    labels = rows.select("label").distinct()
    p = F.lit(per_label).cast("long")
    key = lambda kind, *more: F.concat_ws("|", F.lit(kind), *more)
    same = labels.select(key("same", "label").alias("draw"), "label", (2 * p).alias("n"))
    left = labels.select(key("left", "label").alias("draw"), "label", p.alias("n"))
    partners = labels.join(labels.select(F.col("label").alias("partner")), F.col("label") != F.col("partner"))
    by = Window.partitionBy("label")
    turn = F.row_number().over(by.orderBy(order_key(seed, "label", "partner"), "partner"))
    others = F.count(F.lit(1)).over(by)
    quota = F.floor(p / others) + F.when(turn <= p % others, 1).otherwise(0)
    partners = partners.withColumn("n", quota.cast("long")).filter("n > 0")
    right = partners.select(key("right", "label", "partner").alias("draw"), F.col("partner").alias("label"), "n")
    drawn = ratio_sample(rows, same.unionByName(left).unionByName(right), seed)
    kind = F.substring_index("draw", "|", 1)
    drawn = drawn.withColumn("kind", kind)
    halves = drawn.filter("kind = 'same'").withColumn("at", (F.col("pos") - 1) % p)
    first, second = halves.filter(F.col("pos") <= p), halves.filter(F.col("pos") > p)
    side = lambda df, name: df.select("label", "at", F.col("row_id").alias(name))
    within = side(first, "item1").join(side(second, "item2"), ["label", "at"])
    within = within.select("item1", "item2", F.col("label").alias("device1"), F.col("label").alias("device2"), F.lit(1).alias("equality"))
    owner = F.element_at(F.split("draw", r"\|"), 2)
    sides = drawn.filter("kind = 'right'").select(owner.alias("owner"), F.col("label").alias("device2"), F.col("row_id").alias("item2"), "pos")
    turn = F.row_number().over(Window.partitionBy("owner").orderBy(order_key(seed, "owner", "device2", "item2", "pos"), "device2", "item2", "pos"))
    sides = sides.withColumn("at", turn)
    own = drawn.filter("kind = 'left'").select(F.col("label").alias("owner"), F.col("pos").alias("at"), F.col("row_id").alias("item1"))
    across = own.join(sides, ["owner", "at"]).select("item1", "item2", F.col("owner").alias("device1"), "device2", F.lit(-1).alias("equality"))
    return within.unionByName(across)


def rotated_split(labels: DataFrame, turn: int, n_test: int = 20, n_val: int = 20, step: int = 20, seed: int | None = None, label: str = "label") -> DataFrame:
    """label, position, role: a circular split of the distinct labels.

    Labels are few (devices), so one window orders them.
    """
    distinct = labels.select(label).distinct()
    order = [F.col(label)] if seed is None else [order_key(seed, label), F.col(label)]
    placed = distinct.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    away = F.pmod(F.col("position") - F.lit(turn * step), F.col("n"))
    role = F.when(away < n_test, "test").when(away < n_test + n_val, "val").otherwise("train")
    return placed.select(label, "position", role.alias("role"))


def share_split(labels: DataFrame, first: float = 0.35, second: float = 0.35, seed: int | None = None, label: str = "label") -> DataFrame:
    """label, role: rounded shares of the ordered labels for test and val, the rest for train."""
    placed = rotated_split(labels, 0, seed=seed, label=label).drop("role")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    a, b = F.bround(n * F.lit(first)), F.bround(n * F.lit(second))
    return placed.select(label, F.when(F.col("position") < a, "test").when(F.col("position") < a + b, "val").otherwise("train").alias("role"))


def combinations(spark: SparkSession, labels: list[str], per_size: int = 200, seed: int = 42) -> DataFrame:
    """comb_id, length, combination: all subsets of a size, or ``per_size`` hashed ones where there are more.

    Labels are device names of a fold: tens, not data.
    """
    import hashlib

    labels = sorted(set(labels))
    rows: list[tuple[int, list[str]]] = []
    for m in range(2, len(labels) + 1):
        if math.comb(len(labels), m) <= per_size:
            rows += [(m, list(c)) for c in itertools.combinations(labels, m)]
            continue
        seen: dict[tuple[str, ...], None] = {}
        turn = 0
        while len(seen) < per_size:
            ranked = sorted(labels, key=lambda x: hashlib.md5(f"{seed}:{m}:{turn}:{x}".encode()).hexdigest())
            seen.setdefault(tuple(sorted(ranked[:m])))
            turn += 1
        rows += [(m, list(c)) for c in seen]
    data = [(i, m, c) for i, (m, c) in enumerate(rows)]
    return spark.createDataFrame(data, "comb_id long, length int, combination array<string>")


def balanced_combinations(spark: SparkSession, labels: list[str], count: int, seed: int = 42, allow_repeats: bool = False) -> DataFrame:
    """The same columns for sizes 1 to all: least used labels first, ties by hash."""
    import hashlib

    labels = list(dict.fromkeys(labels))
    data: list[tuple[int, int, list[str]]] = []
    for k in range(1, len(labels) + 1):
        target = count if allow_repeats else min(count, math.comb(len(labels), k))
        used, seen, turn, made = dict.fromkeys(labels, 0), set(), 0, 0
        while made < target and turn < 50 * count:
            turn += 1
            ranked = sorted(labels, key=lambda x: (used[x], hashlib.md5(f"{seed}:{k}:{turn}:{x}".encode()).hexdigest()))
            chosen = tuple(sorted(ranked[:k]))
            if not allow_repeats and chosen in seen:
                continue
            seen.add(chosen)
            for x in chosen:
                used[x] += 1
            data.append((len(data), k, list(chosen)))
            made += 1
    return spark.createDataFrame(data, "comb_id long, length int, combination array<string>")
