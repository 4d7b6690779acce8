"""The registered queries of the probe-fingerprint operators.

The driver's tables hold no captures, so each query runs an operator over a
stand-in: ``probes`` gives every document a text of 40 symbols (unknown for short
documents, else whether a letter occurs) with its language as label; embeddings
stand for numeric features, events for bursts, benchmark texts for hex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import ascii_sum, bit_fingerprint, char_fingerprint, hamming, hamming_text, hex_to_binary, manhattan, u_to_zero, weighted_hamming
from framewright.operators import cluster, decode, evaluate, prep, sampling, training
from framewright.plans import captures, workflow
from framewright.sources import pcap

ALPHABET = "abcdefghijklmnopqrstuvwxyzàâçèéêëîïôöüßñ"
VECTOR_EPS = 7.2
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__.rstrip("_")] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, label, concatenated, source."""

    def symbols(low):
        return F.concat(*(F.when(F.instr(low, c) > 0, "1").otherwise("0") for c in ALPHABET))

    # the lambda binds the lower-cased text, so that it is made once and not for each letter
    known = F.transform(F.array(F.lower("text")), symbols)[0]
    text = F.when(F.length("text") < 200, "U" * len(ALPHABET)).otherwise(known)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), text.alias("concatenated"), "source")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("label"), "embedding")


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the 7 after it: item1, item2, equality and the Hamming distance of their signs."""
    v = vectors(spark, sf_dir).withColumn("signs", F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(-1)))
    a = v.select(F.col("row_id").alias("item1"), F.col("label").alias("l1"), F.col("signs").alias("s1"), F.explode(F.sequence(F.col("row_id") + 1, F.col("row_id") + 7)).alias("item2"))
    b = v.select(F.col("row_id").alias("item2"), F.col("label").alias("l2"), F.col("signs").alias("s2"))
    return a.join(b, "item2").select("item1", "item2", F.when(F.col("l1") == F.col("l2"), 1).otherwise(-1).alias("equality"), "s1", "s2")


def signed(x):
    return F.transform(x, lambda v: F.when(v > 0, 1).otherwise(-1))


@query
def device_distribution(spark, d):
    return prep.device_distribution(probes(spark, d))


@query
def non_randomizing_labels(spark, d):
    return prep.non_randomizing(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("label"), F.col("l_returnflag").alias("mac")))


@query
def clean_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("mac"))
    return prep.clean(e, excluded="click")


@query
def pad_concat(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    padded = prep.pad_columns(p, "U", exclude=["p_partkey"])
    return padded.select("p_partkey", F.concat("p_name", "p_brand", "p_type").alias("concatenated"))


@query
def zero_twin(spark, d):
    return prep.zero_twin(probes(spark, d)).select("row_id", "concatenated")


@query
def length_summary(spark, d):
    return prep.length_summary(probes(spark, d))


@query
def bitmask_filters(spark, d):
    return prep.bitmask_filters(spark, 40)


@query
def filter_labels(spark, d):
    return prep.bitmask_filters(spark, 40).select("filter_id", prep.filter_label(F.col("Bitmask")).alias("fancy"))


@query
def filter_geometry(spark, d):
    return training.filter_geometry(prep.bitmask_filters(spark, 40).select("filter_id", "Bitmask"), "Bitmask")


@query
def burst_split(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return prep.bursts(e, "user_id", ("ts", "event_id"), "value").select("event_id", "user_id", "burst_id")


@query
def bit_pdf(spark, d):
    s = training.symbol_shares(probes(spark, d))
    return s.select("pos", *(F.round(c, 10).alias(c) for c in ("p0", "p1", "pu")))


@query
def bit_entropy(spark, d):
    return training.entropy(probes(spark, d)).select("pos", F.round("h", 10).alias("h"))


@query
def label_entropy(spark, d):
    return training.entropy(probes(spark, d), "label").select("label", "pos", F.round("h", 10).alias("h"))


@query
def suitability(spark, d):
    return training.suitability(probes(spark, d)).select("pos", *(F.round(c, 9).alias(c) for c in ("v", "s", "u")))


def _top(k):
    def run(spark, d):
        return training.train_positions(probes(spark, d), k)

    return run


for _k in (8, 16, 32):
    QUERIES[f"pf_topk_{_k}"] = _top(_k)


@query
def position_threshold(spark, d):
    return spark.createDataFrame([(k, float(training.position_threshold(probes(spark, d), k))) for k in (8, 16)], "num_bits int, threshold double")


@query
def balanced_resample(spark, d):
    return sampling.balanced_resample(probes(spark, d), 200).select("label", "row_id", "pos")


@query
def balance_propagate(spark, d):
    p = probes(spark, d)
    return sampling.propagate(sampling.balanced_resample(p, 100), p.select("row_id", "source")).groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))


@query
def balanced_pairs(spark, d):
    return sampling.balanced_pairs(probes(spark, d), 100)


@query
def rotated_split(spark, d):
    return sampling.rotated_split(probes(spark, d).select("source"), 1, 6, 6, 6, label="source")


@query
def share_split(spark, d):
    return sampling.share_split(probes(spark, d).select("source"), label="source")


def _labels(spark, d):
    return [r[0] for r in probes(spark, d).select("label").distinct().collect()]


@query
def label_combinations(spark, d):
    return sampling.combinations(spark, _labels(spark, d)).select("length", F.array_join("combination", ",").alias("combination"))


@query
def sampled_combinations(spark, d):
    """Combinations where there are more of a size than wanted."""
    return sampling.combinations(spark, _labels(spark, d), per_size=3).select("length", F.array_join("combination", ",").alias("combination"))


@query
def balanced_label_combinations(spark, d):
    return sampling.balanced_combinations(spark, _labels(spark, d), 3).select("comb_id", "length", F.array_join("combination", ",").alias("combination"))


@query
def default_label(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("label"))
    return prep.default_label(e)


@query
def hamming_pairs(spark, d):
    return near_pairs(spark, d).select("item1", "item2", "equality", hamming(F.col("s1"), F.col("s2")).alias("d"))


@query
def hamming_weighted(spark, d):
    confidence = [1.0 + (i % 4) for i in range(64)]
    return near_pairs(spark, d).select("item1", "item2", F.round(weighted_hamming(F.col("s1"), F.col("s2"), confidence), 9).alias("d"))


@query
def pf_fingerprint(spark, d):
    index = [2, 5, 7, 11, 13, 17, 23, 39]
    zero = probes(spark, d).select("row_id", u_to_zero(F.col("concatenated")).alias("concatenated"))
    return evaluate.once_per_text(zero, "concatenated", "fp", char_fingerprint(F.col("concatenated"), index)).select("row_id", "fp")


@query
def bit_fingerprints(spark, d):
    chosen = [(training.mask_text(p, 40), t) for p, t in zip(training.filter_plan(40)[::3], (1, 1, 2, 1, 1, 2, 1), strict=False)]
    zero = probes(spark, d).select("row_id", u_to_zero(F.col("concatenated")).alias("concatenated"))
    done = evaluate.once_per_text(zero, "concatenated", "fp", bit_fingerprint(F.col("concatenated"), chosen))
    return done.select("row_id", F.array_join(F.transform("fp", lambda x: x.cast("string")), ",").alias("fp"))


@query
def pf_pair_distance(spark, d):
    p = probes(spark, d)
    pairs = p.select(F.col("row_id").alias("item1"), (F.col("row_id") + 1).alias("item2"))
    met = evaluate.pair_texts(pairs, p, ["label", "concatenated"])
    return met.select("item1", "item2", hamming_text(F.col("concatenated 1"), F.col("concatenated 2")).alias("d"))


def _curve(spark, d):
    return evaluate.roc(hamming_pairs(spark, d))


@query
def roc_curve(spark, d):
    return _curve(spark, d).select("d", "tp", "fp", F.round("fpr", 10).alias("fpr"), F.round("tpr", 10).alias("tpr"))


@query
def best_tau(spark, d):
    return evaluate.best_tau(_curve(spark, d)).select("best_tau", *(F.round(c, 10).alias(c) for c in ("tpr", "fpr", "dist")))


@query
def auc_trapezoid(spark, d):
    return evaluate.auc_trapezoid(_curve(spark, d)).select(F.round("auc", 9).alias("auc"))


@query
def auc_interpolated(spark, d):
    return evaluate.auc_interpolated(_curve(spark, d)).select(F.round("auc", 8).alias("auc"))


@query
def roc_real(spark, d):
    """The curve of real-valued distances, added up in ranges."""
    v = vectors(spark, d)
    a = v.select(F.col("label").alias("l1"), F.col("embedding").alias("x1"), F.explode(F.sequence(F.col("row_id") + 1, F.col("row_id") + 7)).alias("item2"))
    b = v.select(F.col("row_id").alias("item2"), F.col("label").alias("l2"), F.col("embedding").alias("x2"))
    apart = F.aggregate(F.zip_with("x1", "x2", lambda p, q: F.abs(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    met = a.join(b, "item2").select(F.round(apart, 6).alias("d"), F.when(F.col("l1") == F.col("l2"), 1).otherwise(-1).alias("equality"))
    return evaluate.roc(met, few=0).select("d", "tp", "fp", F.round("fpr", 10).alias("fpr"), F.round("tpr", 10).alias("tpr"))


@query
def roc_one_class(spark, d):
    """Pairs of one class only have no curve: their number, and that of its points."""
    pairs = hamming_pairs(spark, d).filter("equality = 1")
    points = evaluate.roc(pairs).agg(F.count(F.lit(1)).alias("points"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(points)  # one row each


@query
def sums_pair_distance(spark, d):
    """Distances of byte sums, the sides of the pairs scaled apart and together."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.hex(F.encode("p_name", "UTF-8")).alias("a"), F.hex(F.encode("p_brand", "UTF-8")).alias("b"))
    pairs = p.select(F.col("row_id").alias("item1"), F.explode(F.sequence(F.col("row_id") + 1, F.col("row_id") + 3)).alias("item2"))
    apart, together = (evaluate.pair_manhattan(pairs, p, ["a", "b"], joint=j).select("item1", "item2", F.round("d", 9).alias(n)) for j, n in ((False, "apart"), (True, "together")))
    return apart.join(together, ["item1", "item2"])


@query
def role_rows(spark, d):
    """Rows of the labels of each role."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    roles = sampling.rotated_split(docs, 1, 6, 6, 6, label="source").withColumnRenamed("source", "label")
    parts = [workflow.of_role(docs, roles, r, "source").select(F.lit(r).alias("role")) for r in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query
def positions_view(spark, d):
    """All positions that pass the threshold for eight bits."""
    return training.training_view(probes(spark, d), 8)[2]


@query
def auc_by_method(spark, d):
    """Areas of several curves in one table."""
    found = workflow.compare_auc({"signs": _curve(spark, d)})
    return found.select("method", F.round("auc", 8).alias("auc"))


@query
def unique_items(spark, d):
    """The distinct items of both sides of pairs."""
    v = vectors(spark, d).select("row_id")
    pairs = v.select(F.col("row_id").alias("item1"), (F.col("row_id") + 3).alias("item2")).join(v.select(F.col("row_id").alias("item2")), "item2")
    return evaluate.items_of(pairs).select(F.col("item"))


@query
def fingerprint_halves(spark, d):
    """The two halves of the fingerprints as numbers, unmoved."""
    return cluster.projection(prep.zero_twin(probes(spark, d)), "concatenated", 40, jitter=0.0).select("row_id", "x", "y")


@query
def read_model(spark, d):
    """The exported model read back as numbers."""
    return training.read_model(training.model_text(_model(spark, d))).select("best_filter", "threshold", "confidence")


@query
def concatenated_probes(spark, d):
    """The concatenated text of every captured probe."""
    binary = decode.binary_table(captures.probes(table(spark, d, "documents")))
    return prep.concatenate(binary, key=("packet",))


@query
def ascii_sums(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.lower(F.hex(F.encode("text", "UTF-8"))).alias("h"))
    joined = F.concat("h", F.lit(";00"))
    sums = {"s": ascii_sum(F.col("h")), "odd": ascii_sum(F.concat("h", F.lit("f"))), "joined": ascii_sum(joined), "stripped": ascii_sum(joined, ";")}
    return b.select("item_id", *(c.alias(name) for name, c in sums.items()))


@query
def min_max_features(spark, d):
    b = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    s = evaluate.min_max(b, ["p_size", "p_retailprice"])
    return s.select("p_partkey", *(F.round(c, 10).alias(c) for c in ("p_size", "p_retailprice")))


@query
def byte_sum_features(spark, d):
    """Both halves of every text as features."""
    half = F.expr("length(text) div 2").cast("int")
    rest = F.substring(F.col("text"), half + 1, F.length("text"))
    halves = {"a": F.substring(F.col("text"), F.lit(1), half), "b": rest}
    hexes = (F.hex(F.encode(c, "UTF-8")).alias(name) for name, c in halves.items())
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), F.lit("x").alias("Label"), *hexes)
    return evaluate.byte_sum_features(b, ["a", "b"]).select("row_id", F.round("a", 10).alias("a"), F.round("b", 10).alias("b"))


@query
def manhattan_pairs(spark, d):
    """Each vector and the third after it, over all dimensions."""
    v = vectors(spark, d).select("row_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)))
    pairs = v.select(F.col("row_id").alias("item1"), (F.col("row_id") + 3).alias("item2"))
    met = evaluate.pair_texts(pairs, v, [f"x{i}" for i in range(64)])
    return met.select("item1", "item2", F.round(manhattan([(F.col(f"x{i} 1"), F.col(f"x{i} 2")) for i in range(64)]), 6).alias("d"))


@query
def groupby_cluster(spark, d):
    return cluster.group_clusters(probes(spark, d), ["concatenated"]).select("row_id", "cluster")


@query
def cluster_majority(spark, d):
    return cluster.majority_labels(cluster.group_clusters(probes(spark, d), ["concatenated"])).select("cluster", "predicted")


@query
def dbscan_equality(spark, d):
    return cluster.equality_dbscan(probes(spark, d), "concatenated", 6).select("row_id", "cluster")


@query
def dbscan_manhattan(spark, d):
    """Density clusters of all vectors over all dimensions."""
    v = vectors(spark, d).select("row_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)))
    return cluster.dbscan(v, [f"x{i}" for i in range(64)], VECTOR_EPS, 4).select("row_id", "cluster")


def sums(spark, d):
    """Scaled byte sums of parts, the numeric features of the density grid: row_id, label, a, b."""
    hexes = (F.hex(F.encode(c, "UTF-8")).alias(name) for name, c in (("a", "p_name"), ("b", "p_brand")))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("Label"), *hexes)
    return evaluate.byte_sum_features(p, ["a", "b"]).withColumnRenamed("Label", "label")


def _sum_labels(spark, d):
    return [r[0] for r in sums(spark, d).select("label").distinct().collect()]


@query
def sums_grid(spark, d):
    """The density grid over byte sums: every other length of the combinations of part types."""
    combs = cluster.every_other_length(sampling.combinations(spark, _sum_labels(spark, d)))
    m = cluster.grid_metrics(sums(spark, d), ["a", "b"], combs, density=True)
    return m.select("length", "eps", "min_samples", "n_combinations", F.round("v_measure", 8).alias("v_measure"))


@query
def sums_on_combinations(spark, d):
    """Density clusters within every combination of part types, and what they are worth."""
    combs = sampling.combinations(spark, _sum_labels(spark, d))
    m = cluster.test_combinations(sums(spark, d), ["a", "b"], combs, 2, eps=1e-2)
    return m.select("length", *(F.round(c, 8).alias(c) for c in ("v_measure", "ari", "noise_ratio")), "n_clusters")


def _assigned(spark, d):
    return cluster.equality_dbscan(probes(spark, d), "concatenated", 6)


_METRICS = ("homogeneity", "completeness", "v_measure", "ari", "nmi")


@query
def cluster_metrics(spark, d):
    m = cluster.cluster_metrics(_assigned(spark, d))
    return m.select(*(F.round(c, 8).alias(c) for c in (*_METRICS, "noise_ratio", "rmse")), F.col("n_clusters"))


@query
def cluster_metrics_advanced(spark, d):
    m = cluster.cluster_metrics_advanced(_assigned(spark, d))
    names = [f"{c}_{s}" for s in ("all", "clustered") for c in _METRICS]
    return m.select(*(F.round(c, 8).alias(c) for c in (*names, "noise_ratio", "coverage", "label_accuracy")), F.col("n_clusters"))


def _grid(spark, d):
    combs = cluster.every_other_length(sampling.combinations(spark, _labels(spark, d)))
    return cluster.grid_metrics(probes(spark, d), "concatenated", combs)


@query
def dbscan_grid(spark, d):
    return _grid(spark, d).select("length", "eps", "min_samples", "n_combinations", F.round("v_measure", 8).alias("v_measure"))


@query
def dbscan_grid_best(spark, d):
    return cluster.grid_best(_grid(spark, d)).select("eps", "min_samples", "n_lengths", "n_combinations", F.round("v_measure", 8).alias("v_measure"))


@query
def groupby_on_combinations(spark, d):
    combs = sampling.combinations(spark, _labels(spark, d))
    m = cluster.test_combinations(probes(spark, d), "concatenated", combs, None)
    return m.select("length", F.round("v_measure", 8).alias("v_measure"), F.round("ari", 8).alias("ari"), F.round("noise_ratio", 8).alias("noise_ratio"), "n_clusters")


@query
def one_shot_comparison(spark, d):
    m = cluster.compare_one_shot(probes(spark, d), "concatenated", 6)
    return m.select("clustering", "n_clusters", F.round("coverage", 8).alias("coverage"), F.round("v_measure_clustered", 8).alias("v_measure_clustered"))


@query
def metric_by_length(spark, d):
    keys = ["l_returnflag", "l_linestatus"]
    lines = table(spark, d, "lineitem").select(*keys, F.col("l_quantity").cast("double").alias("x"))
    summary = evaluate.series_summary(lines, "x", keys)
    return summary.select(*keys, "n", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "q1", "median", "q3")))


def _hash_pairs(spark, d):
    p = probes(spark, d)
    after = F.explode(F.sequence(F.col("row_id") + 1, F.col("row_id") + 3))
    first = p.select(F.col("row_id").alias("item1"), after.alias("item2"), F.col("label").alias("device1"))
    second = p.select(F.col("row_id").alias("item2"), F.col("label").alias("device2"))
    same = F.when(F.col("device1") == F.col("device2"), 1).otherwise(-1)
    return first.join(second, "item2").select("item1", "item2", "device1", "device2", same.alias("equality"))


@query
def boost_round1(spark, d):
    pairs = training.collapsed_pairs(probes(spark, d), _hash_pairs(spark, d), 40)
    total, base = pairs.agg(F.sum("c").cast("double"), F.sum(F.when(F.col("y") == -1, F.col("c")).otherwise(0)).cast("double")).first()
    errors = training.round_errors(pairs, training.filter_plan(40), F.col("c").cast("double"), base, total)
    return errors.select("filter_id", "threshold", "width", F.round("err", 10).alias("err"))


def _model(spark, d):
    return training.boost(probes(spark, d), _hash_pairs(spark, d))


@query
def boost_model(spark, d):
    """Boosting until the filters run out."""
    return _model(spark, d).select("round", "filter_id", "filter", "threshold", "width", F.round("min_error", 8).alias("min_error"), F.round("confidence", 6).alias("confidence"))


@query
def combination_members(spark, d):
    combs = sampling.combinations(spark, _labels(spark, d))
    return cluster.in_combinations(probes(spark, d), combs).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


@query
def ext_cap_bits(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.hex(F.encode("text", "UTF-8")).alias("h"))
    return b.select("item_id", hex_to_binary(F.col("h")).alias("bits"))


@query
def ext_cap_fields(spark, d):
    b = table(spark, d, "benchmark").select("item_id", decode.extended_bits(F.encode(F.substring("text", 1, 9), "UTF-8")).alias("bits"))
    return b.select("item_id", *decode.extended_fields(F.col("bits")))


@query
def ht_cap_fields(spark, d):
    b = table(spark, d, "benchmark").select("item_id", decode.ht_bits(F.encode(F.substring("text", 1, 26), "UTF-8")).alias("bits"))
    return b.select("item_id", *decode.ht_fields(F.col("bits")))


@query
def channels(spark, d):
    f = spark.range(2400, 5200).select(F.col("id").cast("int").alias("freq"))
    from framewright.functions import freq_to_channel, frequency_to_channel

    return f.select("freq", freq_to_channel(F.col("freq").cast("string")).alias("channel"), frequency_to_channel(F.col("freq")).alias("number"))


@query
def probe_count_window(spark, d):
    """Bursts a label: a window over the burst numbers, as the streaming plan counts them."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    b = prep.bursts(e, "user_id", ("ts", "event_id"), "value")
    return b.groupBy("user_id").agg((F.max("burst_id") + 1).alias("n_bursts"), F.count(F.lit(1)).alias("n_rows"))


@query
def model_text(spark, d):
    """The boosted model as exported."""
    return training.model_text(_model(spark, d))


@query
def capture_hex(spark, d):
    return decode.hex_table(captures.probes(table(spark, d, "documents"))).drop("path")


@query
def capture_binary(spark, d):
    return decode.binary_table(captures.probes(table(spark, d, "documents"))).drop("path")


@query
def capture_dissected(spark, d):
    return decode.dissected_table(captures.probes(table(spark, d, "documents"))).drop("path")


@query
def capture_types(spark, d):
    magics = [(1, bytes.fromhex("d4c3b2a1")), (2, bytes.fromhex("a1b23c4d")), (3, bytes.fromhex("0a0d0d0a")), (4, b"PK\x03\x04"), (5, b"")]
    return spark.createDataFrame(magics, "id int, content binary").select("id", pcap.file_type(F.col("content")).alias("type"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device distribution, group-by clustering and its agreement with the labels."""
    p = probes(spark, sf_dir)
    metrics = cluster.agreement(cluster.contingency(cluster.group_clusters(p, ["concatenated"])))
    totals = prep.device_distribution(p).agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n_rows").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"))
    one = Window.partitionBy()
    a, b = (x.withColumn("one", F.row_number().over(one.orderBy(F.lit(1)))) for x in (totals, metrics))
    return a.join(b, "one").drop("one")
