"""SimHash near-duplicates with pivot distance tables.

Fingerprints. The words of the lower-cased text (A-Z only), their shingles of
``k`` words, XXH64 of each; a bit is set if it is set in over half the hashes.

Links. Fingerprints link at ``radius`` or fewer differing bits. Equal
fingerprints collapse first, so a group of copies counts once. Then:

* *Distance table.* The Hamming distances of every fingerprint to reference
  fingerprints (pivots) are computed once and stored: to the zero fingerprint,
  to ``PIVOTS`` spread ones, and to ``LOCAL`` for each of ``blocks`` runs of bits,
  which differ from zero in that run only. The distance to a pivot of a run less
  the distance to zero is a coordinate that depends on that run alone.
* *Candidates.* By the triangle inequality no coordinate of two fingerprints that
  link differs by more than ``radius``; moreover they differ in at most ``radius``
  runs, so in some ``blocks - radius`` runs the largest difference is 0. One
  bucket table for each choice of runs, keyed by the coordinates of those runs,
  so holds every link. ``blocks`` follows from the number of fingerprints.
* *Discarding.* Each pair that meets is discarded if its largest coordinate
  difference over the spread pivots exceeds ``radius``.
* *Verifying.* Survivors are compared bit by bit.

A bucket yields a spanning forest of its links, not its pairs. The fingerprints
of buckets over ``cap`` are keyed again by finer runs, which part what is not
close in more tables, up to ``FINEST`` runs beyond the radius. Fingerprints that
still meet there agree in all but ``64 * radius / blocks`` bits, so such a bucket
is bounded whatever the input, and is cut into parts, every pair of parts a task.

Components come from rounds of large-star and small-star steps over the forest
edges, each round a table in the shared folder. Fingerprints are the nodes; a
component is then named by the smallest id of its rows.

Defined results: null text has no words; texts without words have fingerprint
zero, linked like any other; fewer than ``k`` words make one shingle; ids may be
of any ordered type; repeated ids give one row per input row; rows with null ids
link like any other and name a component only if it has no other (null).
:func:`keep_first` tells rows apart by id and text: the smallest id stays, null
ids lose, of equal ids the smallest hash of the text; rows that repeat both are
one row written twice. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm._rows import drop_rows, join_groups, mark_of
from framewright.operators.graph import components
from framewright.runtime import materialize, release

SEED = 42
PIVOTS = 24  # spread reference fingerprints
LOCAL = 8  # reference fingerprints of a run
FINEST = 10  # runs beyond the radius in the finest tables
UPPER = bytes(range(0x41, 0x5B))
LOWERED = bytes.maketrans(UPPER, UPPER.lower())


# --- fingerprints ----------------------------------------------------------


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the 64-bit hashes; none for no hashes."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, k: int = 4, chunk: int = 1 << 15) -> int:
    """The 64-bit fingerprint of one text; memory beside the words is bounded by ``chunk`` hashes."""
    words = (text or "").encode().translate(LOWERED).split()  # bytes split at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), chunk):
        spans = zip(starts[at : at + chunk].tolist(), ends[at : at + chunk].tolist(), strict=True)
        values = np.array([hashed(joined[i:j], SEED) for i, j in spans], ">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(fingerprint(t.as_py(), k)) for t in batch.column(1)], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


# --- links -----------------------------------------------------------------


def blocks_for(n: int, radius: int, bucket: float = 1.0) -> int:
    """Runs of bits such that a table's average key is shared by at most ``bucket`` of ``n`` fingerprints."""
    blocks = radius + 2
    while blocks < radius + FINEST and n / 2.0 ** (64 * (blocks - radius) / blocks) > bucket:
        blocks += 1
    return blocks


def runs_of(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each run."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def spread_pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers, so far apart from one another."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(count)], np.uint64)


def local_pivots(blocks: int) -> np.ndarray:
    """``LOCAL`` reference fingerprints for each run, zero outside it; one row a run."""
    masks = [((1 << width) - 1) << (64 - first - width) for first, width in runs_of(blocks)]
    hashes = [[xxhash.xxh64_intdigest(f"{run}:{i}".encode(), SEED) for i in range(LOCAL)] for run in range(blocks)]
    return np.array([[h & mask for h in row] for row, mask in zip(hashes, masks, strict=True)], np.uint64)


def distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot distance table, one row a fingerprint."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def bucket_keys(fps: np.ndarray, blocks: int, radius: int) -> np.ndarray:
    """The keys of each fingerprint, one column a table: a hash of the coordinates of the table's runs."""
    zero = np.bitwise_count(fps).astype(np.int8)
    mixed = np.zeros((len(fps), blocks), np.uint64)
    with np.errstate(over="ignore"):
        for run, pivots in enumerate(local_pivots(blocks)):
            coordinates = distances(fps, pivots) - zero[:, None]  # LOCAL small numbers: one 64-bit word
            word = np.ascontiguousarray(coordinates).view(np.uint64).reshape(-1)
            word = (word ^ (word >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(run)
            mixed[:, run] = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.stack([mixed[:, list(chosen)].sum(axis=1) for chosen in combinations(range(blocks), blocks - radius)], axis=1).view(np.int64)


def distance_table(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    """fp, spread (its distances to the spread pivots, a byte each) and keys (an entry a table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = spread_pivots()
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                own = batch.column(0).to_numpy().view(np.uint64)
                keys = bucket_keys(own, blocks, radius)
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * keys.shape[1])
                spread = pa.array([row.tobytes() for row in distances(own, pivots)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), spread, pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))], ["fp", "spread", "keys"])

    return fps.select("fp").mapInArrow(run, "fp long, spread binary, keys array<long>")


def forest(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that span the components of one bucket.

    A search from each unvisited fingerprint; what it reaches leaves the pool,
    so a dense bucket costs about one look per fingerprint.
    """
    edges: list[tuple[int, int]] = []
    pool = np.arange(len(fps))
    while len(pool):
        queue, pool = [int(pool[0])], pool[1:]
        while queue and len(pool):
            at = queue.pop()
            near = np.flatnonzero(np.abs(table[pool, 0] - table[at, 0]) <= radius)
            for column in range(1, table.shape[1], 6):
                if len(near) == 0:
                    break
                part = slice(column, column + 6)
                near = near[np.abs(table[pool[near], part] - table[at, part]).max(axis=1) <= radius]
            near = near[np.bitwise_count(fps[pool[near]] ^ fps[at]) <= radius]
            if len(near):
                found = pool[near]
                edges += [(int(fps[at]), int(fps[x])) for x in found]
                queue += found.tolist()
                pool = np.delete(pool, near)
    return edges


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tab, key, task, fp, spread) sorted by bucket; a bucket may go on in the next batch."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int8).reshape(-1, PIVOTS))
            if held is not None:
                now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
            key = now[:3]
            new = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            held = [c[last:] for c in now]
            if len(new):
                yield _edges([c[:last] for c in now], np.concatenate([[0], new]), radius)
        if held is not None:
            yield _edges(held, np.array([0, len(held[0])]), radius)

    return run


def _edges(columns: list[np.ndarray], bounds: np.ndarray, radius: int) -> pa.RecordBatch:
    fps, table = columns[3].view(np.uint64), columns[4]
    sizes = np.diff(bounds)
    out: list[tuple[int, int]] = []
    pairs = bounds[:-1][sizes == 2]  # buckets of two, all at once: discard, then verify
    pairs = pairs[np.abs(table[pairs] - table[pairs + 1]).max(axis=1, initial=0) <= radius]
    pairs = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius]
    out += zip(fps[pairs].tolist(), fps[pairs + 1].tolist(), strict=True)
    for at in np.flatnonzero(sizes > 2):
        cut = slice(int(bounds[at]), int(bounds[at + 1]))
        out += forest(fps[cut], table[cut], radius)
    sides = [np.array([e[side] for e in out], np.uint64).view(np.int64) for side in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()) for s in sides], ["u", "v"])


def link_forest(fps: DataFrame, radius: int = 4, cap: int = 16384) -> DataFrame:
    """u, v: edges between fingerprints that span all components of the link graph of the distinct ``fp``."""
    blocks, found = blocks_for(fps.count(), radius), []
    while True:
        table = materialize(distance_table(fps, blocks, radius), "simhash-pivots")
        rows = table.select("fp", "spread", F.posexplode("keys").alias("tab", "key"))
        shared = materialize(rows.groupBy("tab", "key").count().filter("count > 1"), "simhash-shared")
        finest = blocks >= radius + FINEST
        met = rows.join(shared if finest else shared.filter(F.col("count") <= cap), ["tab", "key"])
        parts = F.ceil(F.col("count") / cap).cast("int")
        # part i meets part j: only at the finest runs is there more than one part, and their number is bounded there
        met = met.select("tab", "key", "fp", "spread", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
        meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part")))
        tasks = met.select("tab", "key", F.explode(meets).alias("task"), "fp", "spread")
        dealt = tasks.repartition("tab", "key", "task").sortWithinPartitions("tab", "key", "task")
        found.append(materialize(dealt.mapInArrow(_bucket_edges(radius), "u long, v long").distinct(), "simhash-edges"))
        crowded = shared.filter(F.col("count") > cap)
        if finest or crowded.isEmpty():
            release(table, shared)
            return reduce(DataFrame.unionByName, found)
        fps = materialize(rows.join(crowded.select("tab", "key"), ["tab", "key"], "left_semi").select("fp").distinct(), "simhash-crowded")
        release(table, shared)
        blocks = min(blocks + 4, radius + FINEST)


def grouped(rows: DataFrame, radius: int, cap: int) -> tuple[DataFrame, int]:
    """fp, n, component_id of the distinct fingerprints of ``rows`` (id, fp), and the number of rows."""
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    linked = components(link_forest(fps, radius, cap)).select(F.col("node").alias("fp"), "root")
    members = materialize(fps.join(linked, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "simhash-members")
    names = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(members.join(names, "root").select("fp", "n", "component_id"), "simhash-named"), fps.agg(F.sum("n")).first()[0] or 0


def near_duplicates(docs: DataFrame, radius: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text", cap: int = 16384) -> DataFrame:
    """id, fingerprint (hex), component_id for every row."""
    rows = materialize(fingerprints(docs, k, id_col, text_col), "simhash-rows")
    named, total = grouped(rows, radius, cap)
    met = join_groups(rows, named, ["fp"], total)
    return met.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text", cap: int = 16384) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id."""
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), mark_of(F.col(text_col)).alias("mark"))
    rows = materialize(fingerprints(docs.select(row.alias("row"), F.col(text_col).alias("text")), k, "row", "text").withColumnRenamed("id", "row"), "simhash-rows")
    named, total = grouped(rows.withColumnRenamed("row", "id"), radius, cap)
    lost = join_groups(rows, named, ["fp"], total).filter("row <> component_id").select("row.id", "row.mark")
    repeated = not rows.groupBy("row").count().filter("count > 1").isEmpty()
    return drop_rows(docs, lost, repeated, id_col, mark_of(F.col(text_col)))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
