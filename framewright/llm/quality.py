"""Quality classifier by co-training of two views.

One classifier sees the text (character shares, word and line statistics), the
other the page's metadata: source, language and both together, declared length,
and the layout, that is the lengths of words and lines without their characters.
Both begin with the labelled rows. In every round each scores *all* unlabelled
rows and labels those it is surest of, on both sides, for the other to learn from.

A view may teach a side only where that has shown to help: among the labelled
rows that held-out scores put on the side with that much confidence, the share
of the other class must be at most ``lift`` of its share at large. Held-out
scores come from models fitted without the row's fold but with everything the
other view has taught so far, so after the last round they are those of the
final models; on them both views are calibrated, and their log-odds are summed
in inverse proportion to their held-out loss, calibrated once more.

The surest rows are found without gathering all: confidences are counted in
bins, the bins give the confidence that enough rows reach, and only those rows
are ordered. Fitting uses at most ``labelled`` labelled rows (the smallest
hashes of their ids) and ``per_round`` rows a view, side and round. Features of
all rows are computed once, over whole texts, and stored. Scoring is one pass
without a shuffle.

Defined results: null text is empty; null metadata is a value of its own; the
documents of ids that repeat in ``labels`` take the larger label; rows that
repeat are scored alike; without labels of both classes the score is the share
of good labels (0.5 without any), and a document stays at a score of
``threshold`` or more. An empty table gives an empty result; other columns are
ignored, or kept by :func:`keep_good`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm._worker import forget
from framewright.llm.linear import Linear, fit_logistic, folds_of, logit
from framewright.runtime import materialize, release

LABELLED = 6000
PER_ROUND = 500
ROUNDS = 3
SURE, LIFT, LEAST = 0.9, 0.1, 20
THRESHOLD = 0.5
SOURCES, LANGUAGES, CROSSED = 32, 16, 32
BINS = 64  # of confidence, for each unit of log-odds
FOLDS = 5
CLASS_OF = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    CLASS_OF[_b] = 0 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == "\n" else 5 if _c.isspace() else 6 if _c in ".,;:'\"()-?" else 7
ASCII = np.arange(33, 127)


def text_features(raw: bytes, words: list[bytes], lines: list[bytes]) -> np.ndarray:
    """The text view of one document, over its whole text."""
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(CLASS_OF, weights=counts, minlength=8) / n
    shares = counts / n
    present = shares[shares > 0]
    entropy = float(-(present * np.log2(present)).sum())
    n_words = max(1, len(words))
    distinct = len(set(words))
    statistics = [entropy, np.log1p(n), distinct / n_words, np.log1p(distinct) / np.log1p(n_words + 1), min(n / n_words, 40.0), 1 - len(set(lines)) / len(lines), sum(map(bytes.isupper, words)) / n_words, sum(a == b for a, b in zip(words, words[1:])) / n_words]
    return np.concatenate([classes, statistics, np.sqrt(shares[ASCII])])


def hashed(value: str | None, size: int) -> int:
    return zlib.crc32((value if value is not None else "\0").encode()) % size


def metadata_features(source: str | None, lang: str | None, n_chars: int | None, raw: bytes, words: list[bytes], lines: list[bytes]) -> np.ndarray:
    """The metadata view: origin, declared length, and the lengths of words and lines."""
    origin = np.zeros(SOURCES + LANGUAGES + CROSSED)
    origin[hashed(source, SOURCES)] = origin[SOURCES + hashed(lang, LANGUAGES)] = 1
    origin[SOURCES + LANGUAGES + hashed(None if source is None and lang is None else f"{source}\t{lang}", CROSSED)] = 1
    declared = n_chars if n_chars is not None and n_chars >= 0 else 0
    sizes = np.bincount(np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 63), minlength=64) if words else np.eye(1, 64)[0]
    share = sizes / sizes.sum()
    mean = float(share @ np.arange(64))
    spread = float(np.sqrt(max(0.0, share @ np.arange(64) ** 2 - mean**2)))
    low, high = (int(np.searchsorted(np.cumsum(share), q)) for q in (0.1, 0.9))
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    layout = [np.log1p(declared), float(n_chars is None), np.log1p(len(raw)), min(len(raw) / max(1, declared), 8.0), np.log1p(len(words)), mean, spread, low, high, share[:2].sum(), share[12:].sum()]
    layout += [np.log1p(len(lines)), np.log1p(length.mean()), length.std() / (1 + length.mean()), (length == 0).mean(), len(np.unique(length)) / len(length)]
    return np.concatenate([origin, layout])


def features(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a document."""
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    return text_features(raw, words, lines), metadata_features(source, lang, n_chars, raw, words, lines)


WIDTHS = tuple(map(len, features(None, None, None, None)))


@dataclass
class CoTrained:
    """Both views and their calibrated combination."""

    views: tuple[Linear, Linear]
    calibration: tuple[Linear, Linear]
    combine: Linear
    rounds: list[dict] = field(default_factory=list)  # rows that each view taught, by round
    held_out: dict[str, float] = field(default_factory=dict)  # accuracy of each view and of both on rows not seen

    def margins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of both views."""
        return np.stack([c.margin(v.margin(x)[:, None]) for c, v, x in zip(self.calibration, self.views, (a, b), strict=True)], axis=1)

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.combine(self.margins(a, b))


class Teaching:
    """The labelled rows of both views and what the views have taught each other."""

    def __init__(self, a: np.ndarray, b: np.ndarray, y: np.ndarray):
        self.rows, self.y = (a, b), y
        self.taught: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def add(self, teacher: int, rows: np.ndarray, label: int) -> None:
        """Rows (as the other view sees them) that one view labels for the other."""
        self.taught[1 - teacher].append((rows, np.full(len(rows), float(label))))

    def fit(self, view: int, without: np.ndarray | None = None) -> Linear:
        """The model of a view, perhaps without some labelled rows; taught rows weigh half."""
        own = np.ones(len(self.y), bool) if without is None else ~without
        parts = [(self.rows[view][own], self.y[own]), *self.taught[view]]
        weights = [np.full(len(v), 0.5 if i else 1.0) for i, (_, v) in enumerate(parts)]
        return fit_logistic(np.concatenate([x for x, _ in parts]), np.concatenate([v for _, v in parts]), np.concatenate(weights))

    def held_out(self, view: int) -> np.ndarray:
        """Probabilities of the labelled rows by models that have not seen them."""
        fold, out = folds_of(len(self.y), FOLDS), np.full(len(self.y), 0.5)
        for i in range(FOLDS):
            test = fold == i
            if test.any() and (~test).any():
                out[test] = self.fit(view, test)(self.rows[view][test])
        return out

    def may_teach(self, view: int, sure: float = SURE, lift: float = LIFT) -> list[int]:
        """The sides on which held-out scores of a view earn it trust."""
        p, sides = self.held_out(view), []
        for label in (1, 0):
            tested = p >= sure if label else p <= 1 - sure
            wrong = (self.y[tested] != label).mean() if tested.sum() >= LEAST else 1.0
            if wrong <= lift * (self.y != label).mean():
                sides.append(label)
        return sides

    def finish(self, models: tuple[Linear, Linear], log: list[dict]) -> CoTrained:
        """Calibration and combination on held-out scores of the final models."""
        y, plain = self.y, {"standardise": False, "l2": 1e-3}
        margins = [logit(self.held_out(view)) for view in (0, 1)]
        calibration = tuple(fit_logistic(m[:, None], y, **plain) for m in margins)
        stacked = np.stack([c.margin(m[:, None]) for c, m in zip(calibration, margins, strict=True)], axis=1)
        # calibrated views vote in inverse proportion to their held-out loss; one slope calibrates the vote
        loss = np.maximum((np.logaddexp(0, stacked) - y[:, None] * stacked).mean(axis=0) if len(y) else np.ones(2), 1e-6)
        votes = (1 / loss) / (1 / loss).sum()
        vote = fit_logistic((stacked @ votes)[:, None], y, **plain)
        combine = Linear(np.zeros(2), np.ones(2), votes * vote.weights[0], vote.bias)
        right = {name: float(((p > 0) == (y > 0)).mean()) if len(y) else 0.0 for name, p in (("text", stacked[:, 0]), ("metadata", stacked[:, 1]), ("combined", combine.margin(stacked)))}
        return CoTrained(models, calibration, combine, log, right)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few hundred rows, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def feature_table(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, row (a number of its own for each row), a and b (both views as 32-bit numbers)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in sliced(batches):
            both = [features(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            sides = [pa.array([x[side].astype("<f4").tobytes() for x in both], pa.binary()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides], schema.names)

    read = docs.select(F.col(id_col), F.monotonically_increasing_id(), "text", "source", "lang", "n_chars")
    return materialize(read.mapInArrow(run, schema), "quality-features")


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f4").astype(np.float64).reshape(len(values), width)


def surest(table: DataFrame, known: DataFrame, models: tuple[Linear, Linear], wanted: list[tuple[int, int]], per_round: int) -> list[list]:
    """For each (view, label) wanted, the rows without a label that the view is surest of.

    ``known`` (row) are the rows left out; they grow with the labels, so they meet the scores, three numbers a row, in a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            margins = [m.margin(_matrix(batch.column(1 + i).to_pylist(), WIDTHS[i])) for i, m in enumerate(models)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m) for m in margins)], ["row", "m0", "m1"])

    scored = table.select("row", "a", "b").mapInArrow(run, "row long, m0 double, m1 double")
    scored = materialize(scored.join(known.select("row"), "row", "left_anti"), "quality-scores")
    least, out = float(logit(np.array([SURE]))[0]), []
    for view, label in wanted:
        # a row is taught by the view that is surer of it, so no row is taught twice
        mine, other = F.col(f"m{view}"), F.col(f"m{1 - view}")
        sure = (mine if label else -mine).alias("sure")
        own = scored.filter(F.abs(mine) >= F.abs(other) if view == 0 else F.abs(mine) > F.abs(other)).select("row", sure).filter(F.col("sure") >= least)
        counts = sorted(own.groupBy(F.floor(F.col("sure") * BINS).alias("bin")).count().collect(), key=lambda r: -r["bin"])  # log-odds in bins: a few thousand
        reached, cut = 0, None
        for r in counts:
            reached, cut = reached + r["count"], r["bin"]
            if reached >= per_round:
                break
        out.append([] if cut is None else [r.row for r in own.filter(F.floor(F.col("sure") * BINS) >= cut).orderBy(F.desc("sure"), F.xxhash64("row")).limit(per_round).collect()])
    release(scored)
    return out


def fit_on(table: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND, label_col: str = "quality", id_col: str = "doc_id") -> CoTrained:
    """The co-trained model from a :func:`feature_table` and labels."""
    spark = table.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    chosen = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(labelled)  # at most ``labelled`` rows of three numbers
    rows = table.join(F.broadcast(chosen), "id").select("h", "y", "a", "b").collect()
    rows = sorted({(r.h, r.y, bytes(r.a), bytes(r.b)) for r in rows})  # rows that repeat teach once
    teaching = Teaching(_matrix([r[2] for r in rows], WIDTHS[0]), _matrix([r[3] for r in rows], WIDTHS[1]), np.array([r[1] for r in rows]))
    models, log = (teaching.fit(0), teaching.fit(1)), []
    labelled_rows = out = materialize(table.select("id", "row").join(known, "id", "left_semi").select("row"), "quality-known")
    for _ in range(rounds if len(rows) and 0 < teaching.y.mean() < 1 else 0):
        wanted = [(view, label) for view in (0, 1) for label in teaching.may_teach(view)]
        if not wanted:
            break
        found = surest(table, out, models, wanted, per_round)
        taken = [(row, view, label) for (view, label), part in zip(wanted, found, strict=True) for row in part]
        log.append({f"view{view}_label{label}": len(part) for (view, label), part in zip(wanted, found, strict=True)})
        if not taken:
            break
        lesson = spark.createDataFrame(taken, "row long, view int, label int")
        for r in sorted(table.join(F.broadcast(lesson), "row").collect(), key=lambda r: r.row):
            teaching.add(r.view, _matrix([r["b" if r.view == 0 else "a"]], WIDTHS[1 - r.view]), r.label)
        out = out.unionByName(lesson.select("row"))
        models = (teaching.fit(0), teaching.fit(1))
    release(labelled_rows)
    return teaching.finish(models, log)


def fit_quality(docs: DataFrame, labels: DataFrame, **options) -> CoTrained:
    """The co-trained model; documents and labels meet on ``doc_id`` (``id_col``)."""
    table = feature_table(docs, options.get("id_col", "doc_id"))
    model = fit_on(table, labels, **options)
    release(table)
    return model


def _scored(batch_ids, score: np.ndarray, threshold: float, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch_ids, *(pa.array(np.round(score[:, i], 9)) for i in range(3)), pa.array(score[:, 2] >= threshold)], names)


def _scores(model: CoTrained, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(text view, metadata view, combined) for every row."""
    margins = model.margins(a, b)
    return np.column_stack([1 / (1 + np.exp(-np.clip(margins, -40, 40))), model.combine(margins)])


def score_table(table: DataFrame, model: CoTrained, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """id, text_score, metadata_score, quality_score, keep for every row of a :func:`feature_table`."""
    schema = T.StructType([T.StructField(id_col, table.schema["id"].dataType), *(T.StructField(n, T.DoubleType()) for n in ("text_score", "metadata_score", "quality_score")), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            both = (_matrix(batch.column(1 + i).to_pylist(), WIDTHS[i]) for i in (0, 1))
            yield _scored(batch.column(0), _scores(model, *both), threshold, schema.names)

    return table.select("id", "a", "b").mapInArrow(run, schema)


def score_quality(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The same for documents."""
    return score_table(feature_table(docs, id_col), model, id_col, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    model = fit_quality(docs, labels, **options)
    at = [docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in sliced(batches):
            both = [features(*row) for row in zip(*(part.column(i).to_pylist() for i in at), strict=True)]
            # as stored: the same numbers decide here and in the scored table
            a, b = (np.array([x[side] for x in both], "<f4").astype(np.float64).reshape(len(both), WIDTHS[side]) for side in (0, 1))
            yield part.filter(pa.array(_scores(model, a, b)[:, 2] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    table = feature_table(docs)
    return score_table(table, fit_on(table, labels))
