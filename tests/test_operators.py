import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import ascii_sum, freq_to_channel, frequency_to_channel, hamming, hamming_text, hex_to_binary, pad_array, weighted_hamming
from framewright.operators import blocks, cluster, evaluate, prep, sampling, training
from framewright.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def probes(spark, rows):
    return spark.createDataFrame(rows, "row_id long, label string, concatenated string")


def test_byte_sums(spark):
    for text, total in (("0050f2", 322), ("f", 15), ("", 0), ("ff;00", None), (None, None)):
        assert one(spark, ascii_sum(F.lit(text).cast("string"))) == total
    assert one(spark, ascii_sum(F.lit("ff;00"), ";")) == 255


def test_bits_and_channels(spark):
    assert one(spark, hex_to_binary(F.lit("01"))) == "10000000"
    assert [one(spark, freq_to_channel(F.lit(f))) for f in ("2437", "2484", "5180", "x")] == ["6", "14", "5180", "x"]
    assert [one(spark, frequency_to_channel(F.lit(f))) for f in (2437, 5180)] == [6, 554]
    assert one(spark, pad_array(F.array(F.lit(1), F.lit(2)), 3)) == [1, 2, None]
    assert one(spark, pad_array(F.array(F.lit(1), F.lit(2)), 1)) == [1]


def test_distances(spark):
    a, b = F.array(*map(F.lit, (1, -1, 1))), F.array(*map(F.lit, (1, 1, 1)))
    assert one(spark, hamming(a, b)) == 1
    assert one(spark, weighted_hamming(a, b, [1, 2, 1])) == 1.5
    assert one(spark, hamming_text(F.lit("0U1"), F.lit("011"))) == 1
    with pytest.raises(Exception, match="length"):
        one(spark, hamming_text(F.lit("01"), F.lit("011")))


def test_padding(spark):
    df = spark.createDataFrame([("1", "1"), (None, "0110")], "a string, b string")
    rows = prep.pad_columns(df, "U").collect()
    assert [r.a for r in rows] == ["1UU", "UUU"] and [r.b for r in rows] == ["1UUU", "0110"]
    binary = spark.createDataFrame([(0, "m", "l", "1", "", "0", "0", "1", "1", "1"), (1, "m", "l", "0110", "1", "0", "0", "1", "1", None)], "row_id long, mac string, label string, dsss_parameter string, len_ht_cap string, ht_cap string, len_ext_cap string, ext_cap string, len_vst string, vst string")
    rows = prep.concatenate(binary, vendor_width=4).orderBy("row_id").collect()
    assert rows[0].concatenated == "0001" + "UUU" + "0" + "0" + "1" + "1" + "1UUU"
    assert len({len(r.concatenated) for r in rows}) == 1


def test_filters(spark):
    for length in (16, 20):
        masks = [r.Bitmask for r in prep.bitmask_filters(spark, length).orderBy("filter_id").collect()]
        assert len(masks) == 9 and {len(m) for m in masks} == {length}
        assert masks == [training.mask_text(p, length) for p in training.filter_plan(length)]
    assert one(spark, prep.filter_label(F.lit("00000000NNNN1111"))) == "0[8] ooooxxxx 0[0]"
    assert one(spark, prep.filter_label(F.lit("0000"))) == "0[4]"


def test_bursts(spark):
    df = spark.createDataFrame([(i, "a", int(v, 2)) for i, v in enumerate(("0001", "0110", "0001", "1011"))], "row_id long, label string, dsss long")
    assert [r.burst_id for r in prep.bursts(df).orderBy("row_id").collect()] == [0, 0, 1, 1]


def test_row_ids(spark):
    df = prep.with_row_id(spark.range(1000).select((F.lit(1000) - F.col("id")).alias("k")).repartition(7), "k")
    assert [r.row_id for r in df.orderBy("k").collect()] == list(range(1000))


def test_entropy(spark):
    df = probes(spark, [(0, "a", "00"), (1, "a", "10"), (2, "a", "U0")])
    assert [round(r.h, 12) for r in training.entropy(df).orderBy("pos").collect()] == [1.0, 0.0]


def test_positions_by_threshold(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), "".join(rng.choice("01U" if j % 3 == 0 else "0") if rng.random() < 0.15 else "0" for j in range(12))) for i in range(200)]
    u = {r.pos: r.u for r in training.suitability(probes(spark, rows), 0.5).collect()}
    found = training.position_threshold(probes(spark, rows), 3, 0.5)
    assert sum(v >= found for v in u.values()) >= 3 and sum(v >= found + 0.0011 for v in u.values()) < 3
    top = [r.Index for r in training.train_positions(probes(spark, rows), 3, 0.5).orderBy("rank").collect()]
    assert top == sorted(u, key=lambda p: (-round(u[p], 12), p))[:3]


def test_largest_remainder(spark):
    rows = [(i, "l", v) for i, v in enumerate("aaaaabbbcc")]
    for n, want in ((7, {"a": 4, "b": 2, "c": 1}), (20, {"a": 10, "b": 6, "c": 4})):
        drawn = sampling.balanced_resample(probes(spark, rows), n).join(probes(spark, rows).drop("label"), "row_id")
        assert {r.concatenated: r["count"] for r in drawn.groupBy("concatenated").count().collect()} == want
        assert drawn.count() == n


def test_pair_quotas(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.choice(["00", "01", "11"])) for i in range(60)]
    pairs = sampling.balanced_pairs(probes(spark, rows), 11).collect()
    label = {r[0]: r[1] for r in rows}
    assert all(label[p.item1] == p.device1 and label[p.item2] == p.device2 for p in pairs)
    for d in "abc":
        mine = [p for p in pairs if p.device1 == d]
        assert sum(p.equality == 1 for p in mine) == 11 and sum(p.equality == -1 for p in mine) == 11
        across = [p.device2 for p in mine if p.equality == -1]
        assert sorted(across.count(x) for x in "abc" if x != d) == [5, 6]
    assert sampling.balanced_pairs(probes(spark, [(0, "a", "0"), (1, "a", "1")]), 3).filter("equality = -1").count() == 0


def test_split(spark):
    df = spark.createDataFrame([(f"{i:02d}",) for i in range(63)], "label string")
    roles = {r.position: r.role for r in sampling.rotated_split(df, 1).collect()}
    assert [p for p, r in roles.items() if r == "test"] == list(range(20, 40))
    assert [p for p, r in roles.items() if r == "val"] == list(range(40, 60))


def test_combinations(spark):
    assert sampling.combinations(spark, list("abcd")).count() == 11
    some = sampling.combinations(spark, [f"d{i}" for i in range(12)], 10).collect()
    assert {sum(c.length == m for c in some) for m in range(2, 12)} == {10} and len({tuple(c.combination) for c in some}) == len(some)
    even = sampling.balanced_combinations(spark, list("abcd"), 2).filter("length = 2").collect()
    assert sorted(x for c in even for x in c.combination) == list("abcd")


def test_roc(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (1, -1), (2, -1)], "d int, equality int")
    curve = evaluate.roc(df)
    assert [(r.fpr, round(r.tpr, 9)) for r in curve.orderBy("d").collect()] == [(0.0, round(2 / 3, 9)), (0.5, 1.0), (1.0, 1.0)]
    assert evaluate.best_tau(curve).first().best_tau == 0
    assert math.isclose(evaluate.auc_trapezoid(curve).first().auc, 11 / 12)
    assert 0.8 < evaluate.auc_interpolated(curve).first().auc <= 1
    assert evaluate.roc(df.filter("equality = 1")).count() == 0


def test_cluster_metrics(spark):
    for clusters, want in (([0, 0, 1, 1], (1, 1, 1, 1)), ([0, 0, 0, 0], (0, 1, 0, 0))):
        df = spark.createDataFrame([(i, "aabb"[i], c) for i, c in enumerate(clusters)], "row_id long, label string, cluster int")
        m = cluster.cluster_metrics(df).first()
        assert tuple(round(x, 9) for x in (m.homogeneity, m.completeness, m.v_measure, m.ari)) == want
    noise = spark.createDataFrame([(0, "a", -1), (1, "b", -1)], "row_id long, label string, cluster int")
    m = cluster.cluster_metrics_advanced(noise).first()
    assert m.coverage == 0 and m.v_measure_clustered is None and m.label_accuracy is None
    tie = spark.createDataFrame([(0, "b", 0), (1, "a", 0)], "row_id long, label string, cluster int")
    assert cluster.majority_labels(tie).first().predicted == "a"


def brute_dbscan(points, eps, least):
    near = {i: [j for j, q in points.items() if sum(abs(a - b) for a, b in zip(p, q)) <= eps] for i, p in points.items()}
    core = {i for i in points if len(near[i]) >= least}
    label, number = {}, 0
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x in label:
                continue
            label[x] = number
            todo += [y for y in near[x] if y in core and y not in label]
        number += 1
    return {i: label[i] if i in core else min((label[j] for j in near[i] if j in core), default=-1) for i in points}


def test_dbscan(spark):
    rng = random.Random(5)
    points = {i: (round(rng.gauss(c, 0.3), 2), round(rng.gauss(c, 0.3), 2)) for i, c in enumerate([0, 0, 0, 2, 2, 5] * 20)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "row_id long, x double, y double")
    got = {r.row_id: r.cluster for r in cluster.dbscan(df, ["x", "y"], 0.25, 4).collect()}
    assert got == brute_dbscan(points, 0.25, 4)
    keys = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "row_id long, k string")
    assert [r.cluster for r in cluster.equality_dbscan(keys, "k", 2).orderBy("row_id").collect()] == [0, 0, -1]


@pytest.mark.parametrize(("kind", "eps"), [("wide", 7.2), ("dense", 100.0), ("apart", 0.4), ("whole", 24.0)])
def test_dbscan_many_columns(spark, monkeypatch, kind, eps):
    """Many columns over many blocks; whatever eps is, no table has a row for every link."""
    rng, d, n = random.Random(7), 12, 240
    centre = {i: 3 * rng.randrange(9) if kind == "apart" else 0 for i in range(n)}
    value = (lambda i: rng.randrange(9)) if kind == "whole" else (lambda i: rng.gauss(centre[i], 0.04 if kind == "apart" else 0.7))
    points = {i: tuple(float(value(i)) for _ in range(d)) for i in range(n)}
    sizes, write = [], cluster.materialize

    def counted(df, tag):
        out = write(df, tag)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(cluster, "materialize", counted)
    monkeypatch.setattr(cluster, "LEAST_BLOCK", 50, raising=False)
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], ["row_id", *(f"x{i}" for i in range(d))])
    got = {r.row_id: r.cluster for r in cluster.dbscan(df, [f"x{i}" for i in range(d)], eps, 4).collect()}
    assert got == brute_dbscan(points, eps, 4)
    assert max(sizes) <= 10 * n


def test_blocks_settle_edges():
    """Distances of exactly eps count, those a rounding above do not, with values of any size."""
    x = np.array([[0.0, 0.0, 0.0], [0.1, 0.2, 0.3], [0.1, 0.2, 0.30000000000000004], [1e9, 0.0, 0.0], [1e308, -1e308, 1e308]])
    eps = 0.0 + 0.1 + 0.2 + 0.3
    block = blocks.Block(np.arange(5), x, np.ones(5))
    met = blocks.Meeting(block, block, eps)
    linked = {(int(a), int(b)) for r, c in met.links(np.arange(5), np.arange(5)) for a, b in zip(r, c, strict=True)}
    want = {(i, j) for i in range(5) for j in range(5) if sum(abs(a - b) for a, b in zip(x[i].tolist(), x[j].tolist())) <= eps}
    assert linked == want


def brute_boost(rows, pairs, length, rounds, u):
    text = {r[0]: r[2] for r in rows}
    plan = training.filter_plan(length)
    value = {"0": 0, "1": 1, "U": u}
    sign = {"0": 0, "1": 1, "N": -1}

    def score(t, p):
        return sum(value[c] * sign[m] for c, m in zip(t, training.mask_text(p, length)))

    pairs = sorted(set(pairs))
    weight, out = [1 / len(pairs)] * len(pairs), []
    scores = {p[0]: [(score(text[a], p), score(text[b], p)) for a, b, *_ in pairs] for p in plan}
    for _ in range(rounds):
        best = min((round(sum(w for w, (a, b), q in zip(weight, scores[p[0]], pairs) if (1 if (a > t) == (b > t) else -1) != q[4]), 12), p[2], t, p[0]) for p in plan for t in range(1, p[2] + 1))
        error, _, t, number = best
        confidence = math.log((1 - error) / error)
        out.append((number, t, round(error, 9)))
        plan = [p for p in plan if p[0] != number]
        weight = [w * (math.exp(confidence) if q[4] == 1 and (a > t) != (b > t) else 1) for w, (a, b), q in zip(weight, scores[number], pairs)]
        total = sum(weight)
        weight = [w / total for w in weight]
    return out


@pytest.mark.parametrize("u", [0, 37])
def test_boosting(spark, u):
    rng = random.Random(7)
    base = {d: "".join(rng.choice("01") for _ in range(24)) for d in "abc"}
    rows = [(i, d, "".join(c if rng.random() > 0.2 else rng.choice("01U") for c in base[d])) for i, d in enumerate("abc" * 8)]
    label = {r[0]: r[1] for r in rows}
    chosen = [(a, b, label[a], label[b], 1 if label[a] == label[b] else -1) for a in range(24) for b in rng.sample(range(24), 4)]
    pairs = spark.createDataFrame(chosen, "item1 long, item2 long, device1 string, device2 string, equality int")
    got = [(r.filter_id, r.threshold, round(r.min_error, 9)) for r in training.boost(probes(spark, rows), pairs, 4, u).orderBy("round").collect()]
    assert got == brute_boost(rows, chosen, 24, 4, u)


def test_wide_scores_agree(spark):
    df = probes(spark, [(0, "a", "01U1" * 10)])
    sums = training.block_sums(F.col("concatenated"), 40, 37)
    a, b = df.select(training.scores(sums, 40).alias("a"), training.scores_wide(sums, 40).alias("b")).first()
    assert a == b


def test_model_text(spark):
    model = spark.createDataFrame([(1, 0, "00NN1100", 2, 4, 0.125, 1.9459), (2, 1, "11110000", 1, 4, 1e-20, 46.05)], training.MODEL)
    back = training.read_model(training.model_text(model)).collect()
    assert [r.confidence for r in back] == [1.95, 1e6] and back[0].vector == [0, 0, -1, -1, 1, 1, 0, 0]


def test_csv_and_logs(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(f"h,l\n00000080,{name}\n,{name}2\n")
    df = tables.read_csv(spark, f"file://{tmp_path}", ["h", "l"]).orderBy("row_id")
    assert [(r.h, r.l, r.row_id) for r in df.collect()] == [("00000080", "x", 0), (None, "x2", 1), ("00000080", "y", 2), (None, "y2", 3)]
    assert tables.read_csv(spark, f"file://{tmp_path}", ["h", "l"], one_per_name=True).count() == 2
    (tmp_path / "log.txt").write_text("Best Filter: 0011\nBest Threshold: 2\nMin Error: 0.25\nConfidence: 1.1\nBest Filter: 1100\n")
    rows = tables.read_model_log(spark, f"file://{tmp_path}/log.txt").collect()
    assert [(r.round, r.filter, r.threshold, r.confidence) for r in rows] == [(1, "0011", 2, 1.1)]
    assert tables.read_or_empty(spark, f"file://{tmp_path}/none", "a int").count() == 0


def test_figures(spark):
    import xml.etree.ElementTree as ET

    from framewright.plans import figures

    pairs = spark.createDataFrame([(d, 1 if d < 3 else -1) for d in range(6)] * 2, "d int, equality int")
    curve = evaluate.roc(pairs)
    summary = spark.createDataFrame([("a", 2, 0.5, 0.1), ("a", 3, 0.6, None), ("b", 2, 0.4, 0.0)], "method string, length int, mean double, deviation double")
    points = spark.createDataFrame([(0.0, 0.0, -1), (1.0, 2.0, 0), (1.0, 2.0, 0), (1.0, 2.0, 1)], "x double, y double, cluster int")
    model = spark.createDataFrame([(1, 0, "00NN1100", 2, 4, 0.1, 2.0)], training.MODEL)
    drawn = {
        "lines": figures.roc_figure({"one <&": curve}), "bars": figures.area_figure(spark.createDataFrame([("m", 0.75)], "method string, auc double")),
        "metric": figures.metric_figure(summary), "clusters": figures.cluster_figure(points), "none": figures.cluster_figure(points.limit(0)), "filters": figures.filter_figure(model),
    }
    tags = {k: [x.tag.rpartition("}")[2] for x in ET.fromstring(v).iter()] for k, v in drawn.items()}
    assert tags["lines"].count("polyline") == 1 and tags["bars"].count("rect") == 1 and tags["metric"].count("polygon") == 2
    assert tags["clusters"].count("rect") == 2 and tags["none"].count("rect") == 0 and tags["filters"].count("rect") == 4


def test_running_sums(spark):
    from framewright.operators.number import running

    rng = random.Random(3)
    rows = [(rng.random(), rng.randrange(5)) for _ in range(500)]
    got = running(spark.createDataFrame(rows, "x double, v long"), ["x"], {"s": "v"}, "at").orderBy("at").collect()
    total = 0
    for i, (r, (x, v)) in enumerate(zip(got, sorted(rows))):
        total += v
        assert (r.at, r.x, r.s) == (i, x, total)


def test_balanced_combinations(spark):
    """Every size gets its share, no combination twice, and labels are used evenly."""
    rows = sampling.balanced_combinations(spark, list("abcdef"), 4).collect()
    for k in range(1, 7):
        own = [tuple(r.combination) for r in rows if r.length == k]
        assert len(own) == len(set(own)) == min(4, math.comb(6, k)) and all(list(c) == sorted(set(c)) and len(c) == k for c in own)
        used = [sum(x in c for c in own) for x in "abcdef"]
        assert max(used) - min(used) <= 2
