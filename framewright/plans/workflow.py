"""The whole workflow: captures to tables, tables to balanced probes, and a train, validate and test cycle."""

from __future__ import annotations

import configparser
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import bit_fingerprint, char_fingerprint, hamming_text, weighted_hamming
from framewright.operators import cluster, decode, evaluate, prep, sampling, training
from framewright.runtime import materialize
from framewright.sources import pcap, tables

BITS = (8, 16, 32, 64)


def read_config(path: str) -> dict[str, dict[str, str]]:
    """Sections of an INI file; the path given is the file read."""
    parser = configparser.ConfigParser()
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    return {name: dict(parser[name]) for name in parser.sections()}


def parse_captures(spark: SparkSession, datasets: Mapping[str, str]) -> dict[str, DataFrame]:
    """hex, binary and dissected tables of all datasets (name to capture folder), one row_id for all three.

    Probe requests only, so the rows of the tables agree; frames that cannot be
    dissected are left out (see ``bad`` of :func:`framewright.sources.pcap.read_packets`).
    """
    packets = None
    for name, folder in datasets.items():
        part = pcap.read_packets(spark, folder, name)
        packets = part if packets is None else packets.unionByName(part)
    if packets is None:
        raise ValueError("no dataset")
    numbered = prep.with_row_id(pcap.probe_requests(packets), "path", "packet")
    key = numbered.select("path", "packet", "row_id", "dataset")
    views = {"hex": decode.hex_table, "binary": decode.binary_table, "dissected": decode.dissected_table}
    return {name: materialize(view(numbered).join(key, ["path", "packet"]).drop("path", "packet"), name) for name, view in views.items()}


def parse_configured(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every dataset of an INI file parsed and written where its section says.

    A section has ``raw_path`` (the captures) and ``hex_path``, ``binary_path`` and
    ``dissected_path``, a Parquet folder each; a path that is missing is not written.
    """
    config = read_config(path)
    found = parse_captures(spark, {name: section["raw_path"] for name, section in config.items()})
    for name, section in config.items():
        for kind, df in found.items():
            if f"{kind}_path" in section:
                tables.write(df.filter(F.col("dataset") == name), section[f"{kind}_path"])
    return found


def preprocess(binary: DataFrame) -> dict[str, DataFrame]:
    """binary_u, binary_0 and filters from the binary table."""
    texts = materialize(prep.concatenate(binary), "interim")
    length = texts.agg(F.max(F.length("concatenated"))).first()[0] or 0
    return {"binary_u": texts, "binary_0": prep.zero_twin(texts), "filters": prep.bitmask_filters(binary.sparkSession, length)}


def balance(binary_u: DataFrame, hex_table: DataFrame, n_per_label: int = 500, seed: int = 42) -> dict[str, DataFrame]:
    """The sampled rows of both views, renumbered alike."""
    drawn = prep.with_row_id(sampling.balanced_resample(binary_u, n_per_label, seed).withColumnRenamed("row_id", "old"), "label", "pos").select("old", "row_id")
    drawn = materialize(drawn, "drawn")
    take = lambda df: sampling.propagate(drawn.withColumnRenamed("row_id", "new").withColumnRenamed("old", "row_id"), df).drop("row_id").withColumnRenamed("new", "row_id")
    u = materialize(take(binary_u), "balanced")
    return {"binary_u": u, "binary_0": prep.zero_twin(u), "hex": materialize(take(hex_table), "balanced-hex")}


@dataclass
class Cycle:
    """What one fold yields; every table is lazy until written."""

    roles: DataFrame
    models: dict[str, DataFrame] = field(default_factory=dict)
    curves: dict[str, DataFrame] = field(default_factory=dict)
    taus: dict[str, DataFrame] = field(default_factory=dict)
    grids: dict[str, DataFrame] = field(default_factory=dict)
    tests: dict[str, DataFrame] = field(default_factory=dict)


def of_role(df: DataFrame, roles: DataFrame, role: str, label: str = "label") -> DataFrame:
    """Rows of the labels that have a role."""
    return df.join(roles.filter(F.col("role") == role).select(F.col("label").alias(label)), label, "left_semi")


def with_bits(probes_0: DataFrame, model: DataFrame) -> DataFrame:
    """Boosted fingerprints as bit text, once per distinct text."""
    chosen = [(r.filter, r.threshold) for r in model.orderBy("round").collect()]  # a row a round
    text = F.array_join(F.transform(bit_fingerprint(F.col("concatenated"), chosen), lambda b: F.when(b > 0, "1").otherwise("0")), "")
    return evaluate.once_per_text(probes_0, "concatenated", "fp", text)


def with_positions(probes_0: DataFrame, model: DataFrame) -> DataFrame:
    """Fingerprints of the ranked positions, once per distinct text."""
    index = [r.Index for r in model.orderBy("rank").collect()]  # at most the widest bit budget
    return evaluate.once_per_text(probes_0, "concatenated", "fp", char_fingerprint(F.col("concatenated"), index))


def run_cycle(tables_: Mapping[str, DataFrame], turn: int = 0, n_test: int = 20, n_val: int = 20, pairs_per_label: int = 1000, rounds: int = 64, bits: Sequence[int] = BITS, per_size: int = 10, seed: int = 42) -> Cycle:
    """Train, validate and test the three methods on one rotation of the devices.

    Boosted bits and positions cluster by equal fingerprints, byte sums by density.
    """
    u, zero, hexes = tables_["binary_u"], tables_["binary_0"], tables_["hex"]
    roles = materialize(sampling.rotated_split(u, turn, n_test, n_val, n_test, seed), "roles")
    out = Cycle(roles)
    pairs = {role: materialize(sampling.balanced_pairs(of_role(u, roles, role), pairs_per_label, seed), "pairs") for role in ("train", "val")}
    train = of_role(u, roles, "train")
    out.models["boost"] = training.boost(train, pairs["train"], rounds)
    ranked = materialize(training.train_positions(train, max(bits)), "positions")  # a smaller budget takes the first ranks
    for n in bits:
        out.models[f"positions_{n}"] = ranked.filter(F.col("rank") <= n)
    boosted = materialize(with_bits(zero, out.models["boost"]), "boosted")
    confidence = [r.confidence for r in out.models["boost"].orderBy("round").collect()]
    met = evaluate.pair_texts(pairs["val"].distinct(), boosted, ["fp"])
    for n in (b for b in bits if b <= len(confidence)):
        a, b = (F.substring(f"fp {s}", 1, n) for s in (1, 2))
        out.curves[f"boost_{n}"] = evaluate.roc(met.withColumn("d", hamming_text(a, b)))
        out.curves[f"boost_weighted_{n}"] = evaluate.roc(met.withColumn("d", F.round(weighted_hamming(F.split(a, ""), F.split(b, ""), confidence[:n]), 12)))
    for n in bits:
        sides = evaluate.pair_texts(pairs["val"], with_positions(zero, out.models[f"positions_{n}"]), ["fp"])
        out.curves[f"positions_{n}"] = evaluate.roc(sides.withColumn("d", hamming_text(F.col("fp 1"), F.col("fp 2"))))
    columns = ["HT Capabilities", "Extended Capabilities", "Vendor Specific Tags"]
    for n in (2, 3):
        out.curves[f"sums_{n}"] = evaluate.roc(evaluate.pair_manhattan(pairs["val"], hexes, columns[-n:]))
    out.taus = {name: evaluate.best_tau(curve) for name, curve in out.curves.items()}
    names = {role: [r.label for r in roles.filter(F.col("role") == role).collect()] for role in ("val", "test")}  # device names
    combs = {role: sampling.combinations(u.sparkSession, names[role], per_size, seed) for role in names}
    for n in (b for b in bits if b <= len(confidence)):
        keyed = boosted.withColumn("key", F.substring("fp", 1, n))
        _clusterings(out, f"boost_{n}", keyed, roles, combs)
    for n in bits:
        _clusterings(out, f"positions_{n}", with_positions(zero, out.models[f"positions_{n}"]).withColumnRenamed("fp", "key"), roles, combs)
    for n in (2, 3):
        _sum_clusterings(out, f"sums_{n}", hexes, columns[-n:], roles, combs)
    return out


def _clusterings(out: Cycle, name: str, keyed: DataFrame, roles: DataFrame, combs: Mapping[str, DataFrame]) -> None:
    grid = materialize(cluster.grid_metrics(of_role(keyed, roles, "val"), "key", cluster.every_other_length(combs["val"])), "grid")
    out.grids[name] = grid
    best = cluster.grid_best(grid).first()
    test = of_role(keyed, roles, "test")
    out.tests[f"{name}_groups"] = cluster.test_combinations(test, "key", combs["test"], None)
    if best is not None:
        out.tests[f"{name}_dbscan"] = cluster.test_combinations(test, "key", combs["test"], best.min_samples)


def _sum_clusterings(out: Cycle, name: str, hexes: DataFrame, columns: Sequence[str], roles: DataFrame, combs: Mapping[str, DataFrame]) -> None:
    """Density clusters of byte sums, scaled over the rows of a role; equal sums without a density test."""
    scaled = {role: evaluate.byte_sum_features(of_role(hexes, roles, role), columns, label="label") for role in ("val", "test")}
    grid = materialize(cluster.grid_metrics(scaled["val"], columns, cluster.every_other_length(combs["val"]), density=True), "grid")
    out.grids[name] = grid
    best = cluster.grid_best(grid).first()
    out.tests[f"{name}_groups"] = cluster.test_combinations(scaled["test"], columns, combs["test"], None)
    if best is not None:
        out.tests[f"{name}_dbscan"] = cluster.test_combinations(scaled["test"], columns, combs["test"], best.min_samples, eps=best.eps)


def save_cycle(out: Cycle, folder: str, turn: int, reset: bool = False) -> list[str]:
    """Every table of a cycle as Parquet under ``cycle=<turn>``, and the labels of each role as text.

    What is there already stays unless ``reset``, so a cycle that broke off goes
    on where it was. Returns the paths written.
    """
    spark, base, written = out.roles.sparkSession, f"{folder}/cycle={turn}", []
    parts = {"roles": out.roles} | {f"{kind}/{name}": df for kind in ("models", "curves", "taus", "grids", "tests") for name, df in getattr(out, kind).items()}
    for path, df in parts.items():
        if reset or not tables.written(spark, f"{base}/{path}"):
            tables.write(df, f"{base}/{path}")
            written.append(path)
    if "roles" in written:  # a line a device
        lines = out.roles.select(F.concat_ws("\t", F.upper("role"), "label").alias("value")).orderBy("value").coalesce(1)
        lines.write.mode("overwrite").text(f"{base}/labels")
    return written


def load_cycle(spark: SparkSession, folder: str, turn: int, names: Mapping[str, Sequence[str]]) -> Cycle:
    """A saved cycle; ``names`` has the tables of each kind, those not there are left out."""
    base = f"{folder}/cycle={turn}"
    out = Cycle(spark.read.parquet(f"{base}/roles"))
    for kind, own in names.items():
        getattr(out, kind).update({n: spark.read.parquet(f"{base}/{kind}/{n}") for n in own if tables.written(spark, f"{base}/{kind}/{n}")})
    return out


def compare_auc(curves: Mapping[str, DataFrame]) -> DataFrame:
    """method and the two areas under its curve."""
    united = None
    for name, curve in curves.items():
        part = curve.select(F.lit(name).alias("method"), "d", "fpr", "tpr", "tau")
        united = part if united is None else united.unionByName(part)
    a = evaluate.auc_trapezoid(united, ["method"])
    return a.join(evaluate.auc_interpolated(united, groups=["method"]).withColumnRenamed("auc", "auc_resampled"), "method")


def compare_clusterings(results: Mapping[str, DataFrame], metric: str = "v_measure") -> DataFrame:
    """method, length and the summary of a metric over combinations and cycles."""
    united = None
    for name, df in results.items():
        if metric not in df.columns or "length" not in df.columns:
            raise ValueError(f"{name} has no {metric} by length")
        part = df.select(F.lit(name).alias("method"), "length", metric)
        united = part if united is None else united.unionByName(part)
    return evaluate.series_summary(united, metric, ["method", "length"])
