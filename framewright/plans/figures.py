"""Figures as SVG text, from tables that are small by nature or made so first.

A curve is drawn from at most ``STEPS`` points, a projection from the counts of
a raster; both are reduced by Spark, so what reaches the driver does not grow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import evaluate

STEPS, RASTER = 200, 100
SIZE, EDGE = 480, 50
COLOURS = ("#3366cc", "#dc3912", "#109618", "#990099", "#ff9900", "#0099c6", "#dd4477", "#66aa00", "#b82e2e", "#316395")


def _place(value: float, low: float, high: float, upward: bool = False) -> float:
    share = (value - low) / (high - low) if high > low else 0.5
    return round(EDGE + (1 - share if upward else share) * (SIZE - 2 * EDGE), 2)


def _frame(title: str, x_label: str, y_label: str, body: list[str], ends: tuple[float, float, float, float]) -> str:
    """A drawing with both axes and their ends written on."""
    low, high, bottom, top = (f"{v:.4g}" for v in ends)
    inner = SIZE - EDGE
    axes = [
        f'<text x="{SIZE / 2}" y="20" text-anchor="middle">{escape(title)}</text>',
        f'<path d="M{EDGE} {EDGE}V{inner}H{inner}" fill="none" stroke="black"/>',
        f'<text x="{SIZE / 2}" y="{SIZE - 8}" text-anchor="middle">{escape(x_label)}</text>',
        f'<text x="14" y="{SIZE / 2}" text-anchor="middle" transform="rotate(-90 14 {SIZE / 2})">{escape(y_label)}</text>',
        *(f'<text x="{x}" y="{inner + 15}" text-anchor="middle">{v}</text>' for x, v in ((EDGE, low), (inner, high))),
        *(f'<text x="{EDGE - 4}" y="{y}" text-anchor="end">{v}</text>' for y, v in ((inner, bottom), (EDGE, top))),
    ]
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{SIZE}" height="{SIZE}" font-size="12">', *axes, *body, "</svg>"])


def lines(series: Mapping[str, Sequence[tuple[float, float]]], title: str, x_label: str, y_label: str, bands: Mapping[str, Sequence[tuple[float, float, float]]] | None = None) -> str:
    """A line for each series, with a band (x, low, high) behind it where there is one."""
    every = [p for points in series.values() for p in points] + [(x, y) for b in (bands or {}).values() for x, low, high in b for y in (low, high)]
    xs, ys = [x for x, _ in every] or [0.0], [y for _, y in every] or [0.0]
    ends = (min(xs), max(xs), min(ys), max(ys))
    at = lambda x, y: f"{_place(x, *ends[:2])},{_place(y, *ends[2:], upward=True)}"
    body = []
    for i, (name, points) in enumerate(series.items()):
        colour = COLOURS[i % len(COLOURS)]
        if bands and name in bands:
            around = [at(x, high) for x, _, high in bands[name]] + [at(x, low) for x, low, _ in reversed(bands[name])]
            body.append(f'<polygon points="{" ".join(around)}" fill="{colour}" fill-opacity="0.15"/>')
        body.append(f'<polyline points="{" ".join(at(*p) for p in points)}" fill="none" stroke="{colour}"/>')
        body.append(f'<text x="{SIZE - EDGE}" y="{EDGE + 14 * i}" text-anchor="end" fill="{colour}">{escape(name)}</text>')
    return _frame(title, x_label, y_label, body, ends)


def bars(values: Mapping[str, float], title: str, y_label: str) -> str:
    """A bar for each value, from 0."""
    top = max([0.0, *values.values()])
    width = (SIZE - 2 * EDGE) / max(1, len(values))
    body = []
    for i, (name, value) in enumerate(values.items()):
        y, x = _place(value, 0.0, top, upward=True), EDGE + i * width
        body.append(f'<rect x="{x + width / 8:.2f}" y="{y}" width="{width * 3 / 4:.2f}" height="{SIZE - EDGE - y:.2f}" fill="{COLOURS[i % len(COLOURS)]}"><title>{escape(name)}: {value:.4f}</title></rect>')
        body.append(f'<text x="{x + width / 2:.2f}" y="{y - 3}" text-anchor="middle">{escape(name)}</text>')
    return _frame(title, "", y_label, body, (0, len(values), 0, top))


def roc_figure(curves: Mapping[str, DataFrame]) -> str:
    """The curves of all methods, each at even steps of the false positive rate, with their areas."""
    series = {}
    for name, curve in curves.items():
        points = [(r.fpr, r.tpr) for r in evaluate.resampled(curve, STEPS).orderBy("k").collect()]
        area = evaluate.auc_interpolated(curve, STEPS).first().auc
        series[f"{name} ({area:.3f})"] = points
    return lines(series, "ROC", "false positive rate", "true positive rate")


def area_figure(areas: DataFrame) -> str:
    """A bar for the area of every method (see :func:`framewright.plans.workflow.compare_auc`)."""
    return bars({r.method: r.auc for r in areas.orderBy("method").collect()}, "area under the curve", "area")


def metric_figure(summary: DataFrame, metric: str = "v_measure") -> str:
    """Mean and deviation by length of combination (see :func:`framewright.plans.workflow.compare_clusterings`)."""
    series, around = {}, {}
    for r in summary.orderBy("method", "length").collect():
        off = r.deviation if r.deviation is not None and r.deviation == r.deviation else 0.0
        series.setdefault(r.method, []).append((r.length, r["mean"]))
        around.setdefault(r.method, []).append((r.length, r["mean"] - off, r["mean"] + off))
    return lines(series, metric, "devices", metric, around)


def cluster_figure(points: DataFrame, title: str = "clusters") -> str:
    """Projected points (x, y, cluster) as a raster: a square for each cell, in the colour of its commonest cluster."""
    ends = points.agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max)))).first()
    if ends.lowx is None:
        return _frame(title, "x", "y", [], (0, 0, 0, 0))
    cell = lambda c: F.least(F.floor((F.col(c) - ends[f"low{c}"]) / ((ends[f"high{c}"] - ends[f"low{c}"]) or 1.0) * RASTER), F.lit(RASTER - 1)).alias(c)
    counted = points.select(cell("x"), cell("y"), "cluster").groupBy("x", "y", "cluster").agg(F.count(F.lit(1)).alias("n"))
    shown = counted.groupBy("x", "y").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"), F.sum("n").alias("n")).collect()
    side = (SIZE - 2 * EDGE) / RASTER
    body = []
    for r in sorted(shown, key=lambda r: (r.x, r.y)):
        colour = "#999999" if r.cluster == -1 else COLOURS[r.cluster % len(COLOURS)]
        body.append(f'<rect x="{EDGE + r.x * side:.2f}" y="{SIZE - EDGE - (r.y + 1) * side:.2f}" width="{side:.2f}" height="{side:.2f}" fill="{colour}"><title>{r.n}</title></rect>')
    return _frame(title, "x", "y", body, (ends.lowx, ends.highx, ends.lowy, ends.highy))


def filter_figure(model: DataFrame) -> str:
    """A row for every filter of a model, its positions for (dark) and against (light)."""
    rows = model.orderBy("round").collect()  # a row a round
    length = max((len(r.filter) for r in rows), default=1)
    high = (SIZE - 2 * EDGE) / max(1, len(rows))
    body = []
    for i, r in enumerate(rows):
        for at, symbol in enumerate(r.filter):
            if symbol != "0":
                body.append(f'<rect x="{_place(at, 0, length)}" y="{EDGE + i * high:.2f}" width="{(SIZE - 2 * EDGE) / length:.2f}" height="{high * 0.8:.2f}" fill="{COLOURS[0] if symbol == "1" else COLOURS[4]}"/>')
    return _frame("filters", "position", "round", body, (0, length, len(rows), 1))
