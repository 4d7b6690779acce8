"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. The model of a category sees the
text features and the probabilities of all categories before it. For training,
those are out-of-fold predictions, so later models learn from probabilities as
honest as those they will get. Categories are conditions on the columns of the
label table, so none of them is made from the text; where it has the columns
``toxic`` and ``quality``, the default chain is

1. ``abuse_in_prose``: toxic rows of good or unknown quality;
2. ``abuse_in_junk``: toxic rows of bad quality;
3. ``toxic``: either.

Any label table may name its own (``categories``); the last one decides.

Text features are distinct words, and word beginnings of 5, 6 and 7 letters
counted over distinct words, so a family of word forms adds up. The features
most telling for the last category (chi square) are kept: counting runs as an
aggregation by fold, so every fold selects its features without its own rows,
and only the ``features`` kept of each selection reach the driver.

Training uses at most ``labelled`` rows, the smallest hashes of their ids; the
rest covers all rows and whole texts. Scoring is one pass without a shuffle. The
threshold lies between the held-out probabilities of clean and toxic rows.

Defined results: null text has no words; labels of an id that repeats count as
true where any is, null ones as false; rows that repeat are scored alike; without
labels of both classes the probability is the share of toxic labels (0.5 without
any labels, and then nothing is called toxic); a category without rows of its own
has a constant model. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.linear import Linear, Sparse, fit_logistic, sigmoid
from framewright.runtime import materialize

LABELLED = 8000
FEATURES = 1500
FOLDS = 5
CATEGORIES = {"abuse_in_prose": "toxic = 1 and coalesce(quality, 1) <> 0", "abuse_in_junk": "toxic = 1 and quality = 0", "toxic": "toxic = 1"}
THRESHOLD = 0.5
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (5, 6, 7)


def words_of(text: str | None) -> set[str]:
    """Distinct words in lower case."""
    return set(WORD.findall((text or "").lower()))


def names_of(word: str) -> list[str]:
    """The features a word adds to."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Chain:
    """The kept features and a model for each category."""

    index: dict[str, int]
    models: list[Linear]
    names: tuple[str, ...] = tuple(CATEGORIES)
    threshold: float = THRESHOLD

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by category; each model sees those before it."""
        for model in self.models:
            x = np.column_stack([x, model(x)])
        return x[:, len(self.index) :]


class Scorer:
    """Feature counts of texts, damped, through a bounded store of words, so that a known word costs one look-up."""

    def __init__(self, index: dict[str, int], entries: int = 200_000):
        self.index, self.entries, self.known = index, entries, {}

    def counts(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(self.index), np.float32)
        known, index = self.known, self.index
        found: list[int] = []
        for word in words_of(text):
            hit = known.get(word)
            if hit is None:
                hit = tuple(index[n] for n in names_of(word) if n in index)  # mostly the one empty tuple
                if len(known) >= self.entries:
                    known.clear()
                known[word] = hit
            if hit:
                found += hit
        if found:
            out += np.bincount(found, minlength=len(out)).astype(np.float32)
        return np.log1p(out)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, fold, rows, rows of the last category) of each feature, combined over a few hundred rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts, ys, folds = (batch.column(i).to_pylist() for i in range(3))
            for fold in sorted(set(folds)):
                rows, toxic = Counter(), Counter()
                for text, y, own in zip(texts, ys, folds, strict=True):
                    if own == fold:
                        names = {n for w in words_of(text) for n in names_of(w)}
                        rows.update(names)
                        if y:
                            toxic.update(names)
                found = list(rows)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([fold] * len(found), pa.int32()), pa.array([rows[x] for x in found], pa.int64()), pa.array([toxic[x] for x in found], pa.int64())], ["name", "fold", "n", "t"])


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], labelled: int, id_col: str = "doc_id") -> DataFrame:
    """text, h, fold and a number for each category of at most ``labelled`` labelled ids; these are broadcast, the documents not shuffled."""
    last = list(categories.values())[-1]
    flags = {name: F.coalesce(F.expr(rule), F.lit(False)).cast("double") for name, rule in categories.items()}
    known = labels.filter(F.expr(last).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), *(c.alias(f"y_{n}") for n, c in flags.items()))
    known = known.groupBy("__id").agg(*(F.max(f"y_{n}").alias(f"y_{n}") for n in categories))
    known = known.withColumn("h", F.xxhash64("__id")).orderBy("h", "__id").limit(labelled)
    met = docs.select(F.col(id_col).alias("__doc"), "text").join(F.broadcast(known), F.col("__doc") == F.col("__id"))
    return met.select("text", "h", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), *(f"y_{n}" for n in categories))


def select_features(counted: DataFrame, sizes: dict[int, tuple[float, float]], features: int) -> list[list[str]]:
    """The most telling features without each fold, and at last over all folds."""
    out = []
    for left in (*range(FOLDS), None):
        n, positive = (sum(s[i] for fold, s in sizes.items() if fold != left) for i in (0, 1))
        if not 0 < positive < n:
            out.append([])
            continue
        there, toxic = (F.lit(0) + sum(F.col(f"{c}{k}") for k in range(FOLDS) if k != left) for c in ("n", "t"))
        part = counted.select("name", there.alias("n"), toxic.alias("t")).filter("n >= 3")
        expected = F.col("n") * (positive / n)
        chi = F.pow(F.col("t") - expected, 2) / (expected * (1 - positive / n) * (1 - F.col("n") / float(n)) + 1e-9)
        out.append([r.name for r in part.withColumn("chi", chi).orderBy(F.desc("chi"), "name").limit(features).collect()])
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, features: int = FEATURES, categories: dict[str, str] | None = None, id_col: str = "doc_id") -> Chain:
    """The fitted chain; at most ``labelled`` sparse rows over the kept features reach the driver."""
    categories = CATEGORIES if categories is None else categories
    names = tuple(categories)
    rows = materialize(training_rows(docs, labels, categories, labelled, id_col), "toxic-sample")
    last = F.col(f"y_{names[-1]}")
    sizes = {r.fold: (float(r.n), float(r.t)) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(last).alias("t")).collect()}
    n, positive = (sum(s[i] for s in sizes.values()) for i in (0, 1))
    if not 0 < positive < n:
        y = np.full(int(n), float(positive > 0))
        return Chain({}, [fit_logistic(np.zeros((len(y), i)), y) for i in range(len(names))], names)
    counted = rows.select("text", last.alias("y"), "fold").mapInArrow(_count_features, "name string, fold int, n long, t long")
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("n", "t") for k in range(FOLDS)]
    selections = select_features(materialize(counted.groupBy("name").agg(*by_fold), "toxic-counts"), sizes, features)
    union = {name: i for i, name in enumerate(dict.fromkeys(x for part in reversed(selections) for x in part))}
    shipped = rows.sparkSession.sparkContext.broadcast(union)  # at most ``features`` names a fold

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            xs = [scorer.counts(t) for t in batch.column(0).to_pylist()]
            at = [np.flatnonzero(x) for x in xs]
            sides = [pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([x[a].astype("<f4").tobytes() for x, a in zip(xs, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*sides, *(batch.column(i) for i in range(1, batch.num_columns))], ["at", "value", *batch.schema.names[1:]])

    kept = rows.select("text", "h", "fold", *(f"y_{n}" for n in names))
    schema = "at binary, value binary, h long, fold int, " + ", ".join(f"`y_{n}` double" for n in names)
    seen = sorted(kept.mapInArrow(vectors, schema).collect(), key=lambda r: (r.h, bytes(r["at"]), bytes(r["value"])))
    x = Sparse.of([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["value"], "<f4").astype(float)) for r in seen], len(union))
    ys = {name: np.array([r[f"y_{name}"] for r in seen]) for name in names}
    places = []
    for chosen in selections:
        place = np.full(len(union), -1)
        place[[union[c] for c in chosen]] = np.arange(len(chosen))
        places.append(place)
    models, held_out = fit_chain_on(x, ys, np.array([r.fold for r in seen]), places)
    index = {name: i for i, name in enumerate(selections[-1])}
    return Chain(index, models, names, threshold_of(held_out, ys[names[-1]]))


def fit_chain_on(x: Sparse, categories: dict[str, np.ndarray], fold: np.ndarray, places: list[np.ndarray]) -> tuple[list[Linear], np.ndarray]:
    """A model for each category in order, and the last one's held-out probabilities.

    ``places`` has the columns that each fold may use (chosen without its rows), and at last those of the models.
    """
    models, everything, options = [], np.ones(len(fold), bool), {"l2": 0.5, "standardise": False}
    held_out = np.zeros(len(fold))
    for y in categories.values():
        models.append(fit_logistic(x.part(everything, places[-1]), y, **options))
        held_out = np.full(len(fold), float(y.mean()))
        for k, place in enumerate(places[:-1]):
            test = fold == k
            if test.any() and (~test).any():
                model = fit_logistic(x.part(~test, place), y[~test], **options)
                part = x.part(test, place)
                held_out[test] = sigmoid(part @ model.weights + model.bias)
        x = x.with_column(held_out)
    return models, held_out


def threshold_of(p: np.ndarray, y: np.ndarray, false_share: float = 0.001) -> float:
    """Between the clean rows (all but ``false_share`` of them) and the toxic ones, by held-out probabilities."""
    clean, toxic = p[y == 0], p[y == 1]
    if not len(clean) or not len(toxic):
        return THRESHOLD
    return float(np.clip((np.quantile(clean, 1 - false_share) + np.quantile(toxic, 0.05)) / 2, 0.1, THRESHOLD))


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", threshold: float | None = None) -> DataFrame:
    """id, a probability for each category, and toxic for every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(f"p_{n}", T.DoubleType()) for n in chain.names), T.StructField("toxic", T.BooleanType())])
    threshold = chain.threshold if threshold is None else threshold
    shipped = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES weights a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value.index)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([scorer.counts(t) for t in part.column(1).to_pylist()], np.float64)
                p = shipped.value.predict(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.round(c, 9)) for c in p.T), pa.array(p[:, -1] > threshold)], schema.names)

    return docs.select(id_col, "text").mapInArrow(run, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit_chain(docs, labels))
