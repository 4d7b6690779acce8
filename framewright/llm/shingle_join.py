"""SimHash near-duplicates settled by the Jaccard similarity of shingle sets.

Words, shingles, fingerprints and their pivot distance tables are those of
:mod:`framewright.llm.simhash`. Two rows link if their shingle sets share at
least ``at`` (a fraction, 4/5) of their union; what links, over any number of
steps, is one group. A fingerprint of 64 bits cannot settle that alone: sets
that share 0.8 differ in 4 to 14 bits, and at 14 bits strangers pass in
proportion to the square of the table. So fingerprints within ``radius`` propose
pairs, sets settle them, and what fingerprints miss is completed by keys that
any two sets that link share:

* *SimHash.* The forest of links between fingerprints proposes its edges.
* *Keys.* Sets that link share at least ``ceil(at * n)`` shingles, so in any
  common order of all shingles their first ``n - ceil(at * n) + 1`` have one in
  common; those are the keys of a set. The order puts shingles that are common
  in a sample of the sets last: the sample decides cost only, no order loses a
  pair. Of buckets that hold the same sets one stays.
* *Leaders.* In the bucket of a key every set meets the one of least hash, so
  large groups come together by a number of pairs in proportion.
* *The rest.* Pairs of a bucket that are not yet in one group meet if their sizes
  and the counts of their shingles in ``BINS`` bins allow the threshold (the
  counts of sets that link differ by at most ``(1 - at) / (1 + at)`` of both
  sizes). Of the buckets that a pair shares it meets in the one of least key, as
  far as the least keys of both tell. Buckets over ``cap`` are cut into parts,
  every pair of parts a task.
* *Verifying.* Each pair that met is settled by its whole sets.

Defined results: null text has no words; texts without words are one group; fewer
than ``k`` words make one shingle. Rows are told apart by id and text, null ids
too; the row with the smallest id stays, null ids lose to any other. Rows that
repeat both id and text are one row written twice. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm._rows import drop_rows, join_groups, mark_of
from framewright.llm._worker import forget
from framewright.llm.simhash import LOWERED, SEED, link_forest, majority
from framewright.operators.graph import components
from framewright.runtime import materialize, release

AT = Fraction(4, 5)
BINS = 512
LEAST = 8
SMALL = 500_000  # rows of two or three numbers that may be broadcast, some 10 MB
SAMPLE, COMMON, MOST_COMMON = 8000, 4, 20000


def hashes(text: str | None, k: int) -> np.ndarray:
    """The hash of every shingle, repeats included."""
    words = (text or "").encode().translate(LOWERED).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(words) >= k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends, strict=True)], np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    return np.unique(hashes(text, k).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays), pa.int64()))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """node and shingles of rows with node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t.as_py(), k) for t in batch.column(1)])], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def common_shingles(docs: DataFrame, k: int, text_col: str) -> list[int]:
    """The commonest shingles of a sample of the texts, the rarest of them first."""
    share = max(1, docs.count() // SAMPLE)
    drawn = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text")).filter(F.pmod("node", F.lit(share)) == 0)
    counts = shingle_sets(drawn, k).select(F.explode("shingles").alias("key")).groupBy("key").count().filter(F.col("count") >= COMMON)
    return [r.key for r in counts.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()][::-1]


def described(docs: DataFrame, k: int, at: Fraction, common: list[int], id_col: str, text_col: str) -> DataFrame:
    """id, mark (a hash of the text), node (a hash of the set), fp, n, bins, and the keys of the set, common and other ones."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("mark", "node", "fp", "n")), T.StructField("bins", T.BinaryType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("keys", "common"))])
    late = np.array(sorted(common), np.int64)
    place = np.zeros(len(common), np.int64)
    place[np.searchsorted(late, np.array(common, np.int64))] = np.arange(1, len(common) + 1)

    def parts(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a set, enough for any set that links to share one."""
        if not len(own):
            return own, own
        count = len(own) + (len(own) * -at.numerator) // at.denominator + 1
        if not len(late):
            return own[:count], own[:0]
        found = np.minimum(np.searchsorted(late, own), len(late) - 1)
        rank = np.where(late[found] == own, place[found], 0)
        order = np.argsort(rank, kind="stable")[:count]
        return own[order[rank[order] == 0]], own[order[rank[order] > 0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                every = [hashes(t.as_py(), k) for t in batch.column(2)]
                fps = np.array([majority(h) for h in every], np.uint64).view(np.int64)
                sets = [np.unique(h.view(np.int64)) for h in every]
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                bins = [np.minimum(np.bincount(s & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes() for s in sets]
                keys = [parts(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array(bins, pa.binary()), _lists([x for x, _ in keys]), _lists([x for _, x in keys])], schema.names)

    return docs.select(F.col(id_col), mark_of(F.col(text_col)), F.col(text_col)).mapInArrow(run, schema)


def shared_keys(rows: DataFrame) -> DataFrame:
    """key, node, leader where sets of more than one node have the key."""
    leader = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))
    ends = {"a": F.min("node"), "b": F.max("node"), "leader": leader}
    # only the keys that the sample knows are in many sets: those are combined before the shuffle
    rare = rows.select(F.explode("keys").alias("key"), "node").withColumns({x: e.over(Window.partitionBy("key")) for x, e in ends.items()})
    often = rows.select(F.explode("common").alias("key"), "node")
    often = often.join(often.groupBy("key").agg(*(e.alias(x) for x, e in ends.items())), "key")
    return rare.unionByName(often).filter("a <> b").select("key", "node", F.col("leader.node").alias("leader")).distinct()


def distinct_buckets(met: DataFrame) -> DataFrame:
    """``met`` with one key for all buckets that hold the same sets: documents that share a passage share all its keys."""
    mixed = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    buckets = met.groupBy("key").agg(F.count(F.lit(1)).alias("c"), mixed(1).alias("x"), mixed(2).alias("y"))
    return met.join(buckets.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def proposed(rows: DataFrame, radius: int) -> DataFrame:
    """u, v: sets whose fingerprints are equal or joined in the forest of links."""
    named = materialize(rows.groupBy("fp").agg(F.min("node").alias("first")), "near-fps")
    same = rows.select("fp", "node").join(named, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    side = lambda s, name: named.select(F.col("fp").alias(s), F.col("first").alias(name))
    linked = link_forest(named, radius).join(side("u", "a"), "u").join(side("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return same.unionByName(linked).filter("u <> v")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def possible(pairs: DataFrame, bins: DataFrame, at: Fraction) -> DataFrame:
    """u, v: the pairs whose counts of shingles in bins allow the threshold."""
    side = lambda s: bins.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("bins").alias(f"{s}_bins"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for i in (3, 4))
                n = batch.column(2).to_numpy()
                good = np.abs(a - b).sum(axis=1) * (at.denominator + at.numerator) <= n * (at.denominator - at.numerator)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], ["u", "v"])

    met = pairs.join(side("u"), "u").join(side("v"), "v")
    return met.select("u", "v", (F.col("u_n") + F.col("v_n")).alias("n"), "u_bins", "v_bins").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, k: int, at: Fraction, id_col: str, text_col: str) -> DataFrame:
    """u, v: the pairs whose sets link. Only texts of the pairs are looked up."""
    pairs = materialize(pairs, "near-pairs")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    one = rows.select("id", "mark", "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("one"))
    one = materialize(one.select("node", F.col("one.id").alias("id"), F.col("one.mark").alias("mark")), "near-one")
    one = F.broadcast(one) if one.count() <= SMALL else one  # spares the shuffle of all texts
    texts = docs.select(F.col(id_col).alias("own"), mark_of(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    texts = texts.join(one, (F.col("hash") == F.col("mark")) & F.col("own").eqNullSafe(F.col("id"))).select("node", "text")
    sets = materialize(shingle_sets(texts, k), "near-sets")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"{s}_set"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    union = F.size("u_set") + F.size("v_set") - both
    met = pairs.join(side("u"), "u").join(side("v"), "v").filter(both * at.denominator >= union * at.numerator)
    return materialize(met.select("u", "v").distinct(), "near-links")  # a row written twice has its set twice


def _meetings(at: Fraction):
    def pairs(key: int, nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, bins: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(sizes, kind="stable")
        nodes, roots, sizes, bins, least = nodes[order], roots[order], sizes[order], bins[order], least[order]
        last = np.searchsorted(sizes, sizes * at.denominator // at.numerator, "right")
        for i in range(len(nodes) - 1):
            to = np.arange(i + 1, last[i])
            to = to[roots[to] != roots[i]]
            mine = least[i][least[i] < key]
            if len(to) and len(mine):  # a pair with a smaller key in common meets there
                to = to[~np.isin(least[to], mine).any(axis=1)]
            if len(to):
                apart = np.abs(bins[to].astype(np.int16) - bins[i]).sum(axis=1)
                to = to[apart * (at.denominator + at.numerator) <= (sizes[to] + sizes[i]) * (at.denominator - at.numerator)]
                yield np.minimum(nodes[to], nodes[i]), np.maximum(nodes[to], nodes[i])

    def settle(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, task = rows[:2]
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (task[1:] != task[:-1])) + 1, [len(key)]])
        met = [p for a, b in zip(cuts[:-1], cuts[1:], strict=True) for p in pairs(key[a], *(c[a:b] for c in rows[2:]))]
        sides = [np.concatenate([p[s] for p in met]) if met else np.zeros(0, np.int64) for s in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()) for s in sides], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and task; a task may go on in the next batch."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(5)]
            now.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, BINS))
            now.append(batch.column(6).flatten().to_numpy().reshape(-1, LEAST))
            if held is not None:
                now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
            new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            held = [c[last:] for c in now]
            if last:
                yield settle([c[:last] for c in now])
        if held is not None:
            yield settle(held)

    return run


def least_keys(rows: DataFrame) -> DataFrame:
    """node, least: the ``LEAST`` smallest keys of each node, filled up with the largest number."""
    fill = F.array_repeat(F.lit((1 << 63) - 1), LEAST)
    keys = F.concat(F.array_sort(F.collect_set("key")), fill)
    return rows.groupBy("node").agg(F.slice(keys, 1, LEAST).alias("least"))


def link_groups(docs: DataFrame, rows: DataFrame, k: int, at: Fraction = AT, cap: int = 512, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, root: the group of every node of ``rows`` (:func:`described`) that links to another."""
    every = materialize(shared_keys(rows), "near-keys")
    met = materialize(distinct_buckets(every), "near-met")
    release(every)
    sets = materialize(rows.select("node", "n", "bins").join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "near-bins")
    led = met.filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    first = verified(possible(ordered(proposed(rows, radius).unionByName(led)), sets, at), docs, rows, k, at, id_col, text_col)
    groups = components(first)

    rooted = materialize(met.join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-rooted")
    live = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("c")).filter("a <> b").select("key", F.ceil(F.col("c") / cap).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    one = F.array(F.lit(0))
    many = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part")))
    open_ = materialize(rooted.join(live, "key"), "near-open")
    known = materialize(sets.join(least_keys(open_), "node"), "near-known")
    tasks = open_.withColumn("part", part).join(known, "node")
    tasks = tasks.select("key", F.explode(F.when(F.col("parts") == 1, one).otherwise(many)).alias("task"), "node", "root", "n", "bins", "least")
    found = tasks.repartition("key", "task").sortWithinPartitions("key", "task").mapInArrow(_meetings(at), "u long, v long").distinct()
    return components(first.unionByName(verified(found, docs, rows, k, at, id_col, text_col)))


def keep_first(docs: DataFrame, k: int = 5, at: Fraction = AT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id."""
    rows = materialize(described(docs, k, at, common_shingles(docs, k, text_col), id_col, text_col), "near-rows")
    groups = link_groups(docs, rows, k, at, id_col=id_col, text_col=text_col, **options)
    row = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    nodes = rows.groupBy("node").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n")).join(groups, "node", "left")
    nodes = materialize(nodes.select("node", "n", "least", F.coalesce("root", "node").alias("root")), "near-nodes")
    named = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("c")).filter("c > 1"), "root").select("node", "n", "first")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    lost = join_groups(rows.select("id", "mark", "node"), named, ["node"], total).filter(row != F.col("first"))
    repeated = not rows.groupBy("id", "mark").count().filter("count > 1").isEmpty()
    return drop_rows(docs, lost, repeated, id_col, mark_of(F.col(text_col)))
