"""Entropy-ranked bit positions and boosted bit-mask filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.runtime import materialize

MODEL = "round int, filter_id int, filter string, threshold int, width int, min_error double, confidence double"


# --- entropy ---------------------------------------------------------------


def symbol_counts(df: DataFrame, *groups: str) -> DataFrame:
    """groups, pos, n0, n1, nu, n: symbols at each position, from distinct texts and their counts."""
    texts = df.groupBy(*groups, "concatenated").agg(F.count(F.lit(1)).alias("c"))
    at = texts.select(*groups, "c", F.posexplode(F.split("concatenated", "")).alias("pos", "symbol"))
    some = lambda s: F.sum(F.when(F.col("symbol") == s, F.col("c")).otherwise(0))
    return at.groupBy(*groups, "pos").agg(some("0").alias("n0"), some("1").alias("n1"), some("U").alias("nu"), F.sum("c").alias("n"))


def symbol_shares(df: DataFrame, *groups: str) -> DataFrame:
    """groups, pos, p0, p1, pu."""
    counted = symbol_counts(df, *groups)
    return counted.select(*groups, "pos", *((F.col(a) / F.col("n")).alias(b) for a, b in (("n0", "p0"), ("n1", "p1"), ("nu", "pu"))))


def entropy(df: DataFrame, *groups: str) -> DataFrame:
    """groups, pos, h: entropy to base 3 at each position."""
    term = lambda p: F.when(F.col(p) > 0, F.col(p) * F.ln(p)).otherwise(0.0)
    total = (term("p0") + term("p1") + term("pu")) / F.lit(math.log(3))
    return symbol_shares(df, *groups).select(*groups, "pos", F.abs(total).alias("h"))


def suitability(df: DataFrame, least: float = 0.8) -> DataFrame:
    """pos, v, s, u: entropy over all rows, mean of one less the entropy in each label, and v where s is enough."""
    s = entropy(df, "label").groupBy("pos").agg(F.avg(1 - F.col("h")).alias("s"))
    v = entropy(df).select("pos", F.col("h").alias("v"))
    # the guard absorbs rounding of sums taken in another order
    return v.join(s, "pos").withColumn("u", F.when(F.round("s", 12) >= least, F.col("v")).otherwise(0.0))


def train_positions(df: DataFrame, num_bits: int = 64, least: float = 0.8) -> DataFrame:
    """rank, Index: the ``num_bits`` positions of highest u, ties by position."""
    from pyspark.sql import Window

    best = suitability(df, least).withColumn("u", F.round("u", 12)).orderBy(F.desc("u"), "pos").limit(num_bits)
    rank = F.row_number().over(Window.orderBy(F.desc("u"), "pos"))  # at most num_bits rows
    return best.select(rank.alias("rank"), F.col("pos").alias("Index"))


def position_threshold(df: DataFrame, num_bits: int = 64, least: float = 0.8) -> float:
    """The threshold on u, in steps of 0.001 from 1, that lets ``num_bits`` positions pass."""
    rows = suitability(df, least).orderBy(F.desc("u"), "pos").limit(num_bits).select("u").collect()
    if len(rows) < num_bits:
        return 0.0
    return max(0.0, 1 - 0.001 * math.ceil(round((1 - rows[-1].u) / 0.001, 9)))


def training_view(df: DataFrame, num_bits: int = 64, least: float = 0.8) -> tuple[float, DataFrame, DataFrame]:
    """(threshold, pos and u of all positions, the positions that pass it, in order of u)."""
    found, u = position_threshold(df, num_bits, least), suitability(df, least).select("pos", "u")
    return found, u, u.filter(F.col("u") >= found).orderBy(F.desc("u"), "pos").select(F.col("pos").alias("Index"))


# --- boosting --------------------------------------------------------------


def block_sums(text: Column, length: int, u_value: int = 0, step: int = 4) -> Column:
    """array<int>: ones in every aligned run of ``step`` symbols, unknown ones counting ``u_value``."""
    part = lambda i: F.substring(text, i * step + 1, F.lit(step))
    ones = lambda p: F.length(p) - F.length(F.translate(p, "1", ""))
    unknown = lambda p: (F.length(p) - F.length(F.translate(p, "U", ""))) * u_value
    return F.transform(F.sequence(F.lit(0), F.lit(max(0, length // step - 1))), lambda i: ones(part(i)) + unknown(part(i)))


def filter_plan(length: int) -> list[tuple[int, int, int, int]]:
    """(filter_id, start, block, kind) in the order of :func:`framewright.operators.prep.bitmask_filters`."""
    out, number = [], 0
    for block in (8, 16):
        for start in range(0, length - block + 1, block):
            for kind in range(3):
                out.append((number, start, block, kind))
                number += 1
    return out


def scores(sums: Column, length: int) -> Column:
    """array<int>: the score of every bit-mask filter from the run sums of a text."""
    parts = []
    for _, start, block, kind in filter_plan(length):
        h = block // 8
        first = [F.get(sums, F.lit(start // 4 + i)) for i in range(h)]
        second = [F.get(sums, F.lit(start // 4 + h + i)) for i in range(h)]
        a, b = sum(first[1:], first[0]), sum(second[1:], second[0])
        parts.append(b - a if kind == 0 else a - b if kind == 1 else a + b)
    return F.array(*parts)


def scores_wide(sums: Column, length: int) -> Column:
    """The same without an expression for each filter: for texts of many hundred symbols."""
    eights = 3 * (length // 8)
    every = eights + 3 * (length // 16)
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def one(i: Column) -> Column:
        small = i < eights
        third = F.floor(F.when(small, i).otherwise(i - eights) / 3).cast("int")
        half = F.when(small, 1).otherwise(2)
        first = third * 2 * half + 1
        a, b = add(F.slice(sums, first, half)), add(F.slice(sums, first + half, half))
        return F.when(i % 3 == 0, b - a).when(i % 3 == 1, a - b).otherwise(a + b)

    return F.transform(F.sequence(F.lit(0), F.lit(max(every - 1, 0))), one)


def collapsed_pairs(probes: DataFrame, pairs: DataFrame, length: int, u_value: int = 0) -> DataFrame:
    """y, c, lo, hi: pairs of equal texts as one row with its count, and both scores of each filter in order."""
    pairs = pairs.select("item1", "item2", "device1", "device2", "equality").distinct()
    texts = probes.select("row_id", "concatenated")
    a = texts.select(F.col("row_id").alias("item1"), F.col("concatenated").alias("t1"))
    b = texts.select(F.col("row_id").alias("item2"), F.col("concatenated").alias("t2"))
    met = pairs.join(a, "item1").join(b, "item2").groupBy(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2"), F.col("equality").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    score = scores if length <= 128 else scores_wide
    first = score(block_sums(F.col("t1"), length, u_value), length)
    both = met.withColumns({"a": first, "b": score(block_sums(F.col("t2"), length, u_value), length)})
    return both.select("y", "c", F.zip_with("a", "b", lambda x, y: F.least(x, y)).alias("lo"), F.zip_with("a", "b", lambda x, y: F.greatest(x, y)).alias("hi"))


def round_errors(pairs: DataFrame, plan: list[tuple[int, int, int, int]], weight: Column, base: float, total: float) -> DataFrame:
    """filter_id, threshold, width, err, wrong for every candidate.

    The two sides of a pair are told apart at t iff lo <= t < hi, so the error
    is the weight of unequal pairs plus the signed weight of pairs told apart.
    ``wrong`` is the weight of equal pairs told apart.
    """
    spread = pairs.select("y", weight.alias("w"), F.posexplode(F.arrays_zip("lo", "hi")).alias("filter_id", "s")).filter("s.lo < s.hi")
    summed = spread.groupBy("filter_id", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), "y").agg(F.sum("w").alias("w"))
    widths = pairs.sparkSession.createDataFrame([(f, b) for f, _, b, _ in plan], "filter_id int, width int")
    inside = summed.join(F.broadcast(widths), "filter_id")  # a row for each filter of the length
    low, high = F.greatest("lo", F.lit(1)), F.least(F.col("hi") - 1, F.col("width"))
    told = inside.filter(low <= high).select("filter_id", F.explode(F.sequence(low, high)).alias("threshold"), "y", "w")
    told = told.groupBy("filter_id", "threshold").agg(F.sum(F.col("y") * F.col("w")).alias("yw"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("wrong"))
    every = widths.select("filter_id", "width", F.explode(F.sequence(F.lit(1), "width")).alias("threshold"))
    err = (F.lit(base) + F.coalesce("yw", F.lit(0.0))) / F.lit(total)
    return every.join(told, ["filter_id", "threshold"], "left").select("filter_id", "threshold", "width", err.alias("err"), F.coalesce("wrong", F.lit(0.0)).alias("wrong"))


def boost(probes: DataFrame, pairs: DataFrame, rounds: int = 64, u_value: int = 0, n_filters: int = 0) -> DataFrame:
    """The boosted model, one row a round.

    A weight is a function of the chosen (filter, threshold) so far, so rounds
    share one static table and add a term to an expression; nothing is carried
    from round to round but one row, which also says how the sums of the weights
    change, so a round is one job. ``u_value`` is what an unknown symbol counts
    (37 reproduces training on character codes). Ends early when filters run out.
    """
    spark = probes.sparkSession
    length = probes.agg(F.max(F.length("concatenated"))).first()[0] or 0
    plan = filter_plan(length)[: n_filters or None]
    static = materialize(collapsed_pairs(probes, pairs, length, u_value), "boost-pairs")
    log_weight, model, left = F.lit(0.0), [], list(plan)
    count = F.col("c").cast("double")
    total, base = static.agg(F.sum(count), F.sum(F.when(F.col("y") == -1, count).otherwise(0.0))).first()
    for number in range(1, rounds + 1):
        if not left or not total:
            break
        errors = round_errors(static, left, count * F.exp(log_weight), base, total)
        best = errors.orderBy(F.round("err", 12), "width", "threshold", "filter_id").first()
        error = best.err if best.err > 0 else 1e-20
        confidence = math.log((1 - error) / error) if error < 1 else float("-inf")
        chosen = next(p for p in plan if p[0] == best.filter_id)
        model.append((number, best.filter_id, mask_text(chosen, length), best.threshold, best.width, float(error), confidence))
        left = [p for p in left if p[0] != best.filter_id]
        wrong = (F.col("y") == 1) & (F.get("lo", F.lit(best.filter_id)) <= best.threshold) & (F.get("hi", F.lit(best.filter_id)) > best.threshold)
        log_weight = log_weight + F.when(wrong, F.lit(confidence)).otherwise(0.0) - F.lit(math.log(total))
        total, base = 1 + (best.wrong * math.expm1(confidence) / total if best.wrong else 0.0), base / total
    return spark.createDataFrame(model, MODEL)


def mask_text(plan: tuple[int, int, int, int], length: int) -> str:
    """The ``0``/``1``/``N`` text of a filter."""
    _, start, block, kind = plan
    h = block // 2
    return "0" * start + ("N" if kind == 0 else "1") * h + ("N" if kind == 1 else "1") * h + "0" * (length - start - block)


def model_text(model: DataFrame) -> DataFrame:
    """The model as exported text: rounded errors and confidences."""
    from framewright.operators.prep import filter_label

    error = F.when(F.col("min_error") < 1e-10, "0").otherwise(F.format_string("%.2e", "min_error"))
    confidence = F.when(F.col("confidence") > 40, "inf").otherwise(F.format_string("%.2f", "confidence"))
    columns = {"best_filter_fancy": filter_label(F.col("filter")), "best_filter": F.col("filter"), "best_threshold": F.col("threshold"), "min_error": error, "confidence": confidence}
    return model.select(*(c.alias(name) for name, c in columns.items()))


def read_model(text: DataFrame) -> DataFrame:
    """Exported text as numbers: unreadable confidence 0, infinite 1e6, missing columns 0."""
    number = lambda c: F.col(c).try_cast("double") if c in text.columns else F.lit(0.0)
    confidence = F.coalesce(number("confidence"), F.lit(0.0))
    confidence = F.when(F.abs(confidence) == float("inf"), 1e6).otherwise(F.nanvl(confidence, F.lit(0.0)))
    threshold = F.coalesce(number("best_threshold").cast("int"), F.lit(0))
    vector = F.transform(F.split("best_filter", ""), lambda c: F.when(c == "1", 1).when(c == "N", -1).otherwise(0))
    return text.select("best_filter", vector.alias("vector"), threshold.alias("threshold"), confidence.alias("confidence"))


def filter_geometry(model: DataFrame, column: str = "filter") -> DataFrame:
    """width and first used position of every filter."""
    used = F.length(F.translate(column, "0", ""))
    return model.select("*", used.alias("used"), F.when(used > 0, F.length(F.regexp_extract(column, "^(0*)", 1))).alias("first_used"))
