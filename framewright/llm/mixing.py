"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells (source, language, topic). Raking scales the
cells until their margins meet the targets of all three dimensions, and every
document of a cell then has one inclusion probability. All of it is DataFrame
operations: the cells are never collected, margins are partial aggregates, and
what sweeps leave is a small table in the shared folder, so a plan does not
contain all the sweeps before it.

Topics. A table with a column ``topic`` has its own. Otherwise topics are led by
terms: of the words of four letters or more of a language, the ``TERMS`` that most
of its documents hold, but no more than half of them; the k-th of every language
leads topic ``t<k>``, so that topics cross languages and their margins do not
contradict those of the languages. A document belongs to the topic whose term
weighs most in it (occurrences times the log of the language's documents over
those that hold it). Languages under a hundredth of the documents share one pool.

Targets default to tempered shares: a value with token share ``s`` is aimed at
``s ** power``, rescaled to one. ``targets`` may name shares for some values of
a dimension instead; values it does not name keep their tempered share, and all
are rescaled. Sweeps run by the ``SWEEPS`` until no cell moves by ``TOLERANCE``;
if ``MOST`` do not get there (margins that contradict each other), a warning says
by how much. Up to ``FEW`` cells are swept in one task, more in joins. The budget is a share of all tokens:
probabilities are ``min(1, k * factor)`` with ``k`` solved so that the expected
tokens meet it; where a cell is full, its margins fall short, see :func:`margins`.

Defined results: null source, language or topic is the value ``(none)``, and so
is the topic of a text without any of the terms; null text has no tokens;
documents of cells without tokens get factor 0 and are never sampled, unless the
whole table has no tokens, where the result has factor 0 throughout. Rows with
equal ids draw the same number; rows that repeat count as often as they occur.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.runtime import materialize, release

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
SWEEPS, MOST, TOLERANCE = 12, 60, 1e-5
FEW = 100_000  # cells that one task sweeps
SOLVE = 40
TERMS = 6
POOL = 100  # a language has terms of its own from 1/POOL of the documents on, so at most POOL languages do
NONE = "(none)"
WORD = r"\p{L}{4,}"


def words_of(text: Column) -> Column:
    """Words of four letters or more, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def topic_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", terms: int = TERMS) -> dict[str, list[tuple[str, float]]]:
    """For each large language, and for the ``""`` pool, the (term, weight) that lead topics: counted over all documents."""
    sizes = docs.groupBy(F.coalesce(F.col(lang_col), F.lit(NONE)).alias("lang")).agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes, "mix-languages")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    large = [r.lang for r in sizes.filter(F.col("size") * POOL >= total).collect()]  # at most POOL
    pool = lambda lang: F.when(lang.isin(large), lang).otherwise("")
    pools = sizes.groupBy(pool(F.col("lang")).alias("pool")).agg(F.sum("size").alias("size"))
    words = F.explode(F.array_distinct(words_of(F.coalesce(F.col(text_col), F.lit("")))))
    counted = docs.select(pool(F.coalesce(F.col(lang_col), F.lit(NONE))).alias("pool"), words.alias("term")).groupBy("pool", "term").agg(F.count(F.lit(1)).alias("n"))
    common = materialize(counted.join(F.broadcast(pools), "pool").filter(2 * F.col("n") <= F.col("size")).filter("n > 1"), "mix-terms")
    found = {}
    for r in pools.collect():
        best = common.filter(F.col("pool") == r.pool).orderBy(F.desc("n"), "term").limit(terms)
        found[r.pool] = [(x.term, x.w) for x in best.select("term", F.ln(F.col("size").cast("double") / F.col("n")).alias("w"), "n").orderBy(F.desc("n"), "term").collect()]
    return found


def leading(text: Column, terms: list[tuple[str, float]]) -> Column:
    """The topic (``t1`` and so on) whose term weighs most in a text, the first of equals; null without any."""
    if not terms:
        return F.lit(None).cast("string")
    weights = F.create_map(*(F.lit(x) for term, w in terms for x in (term, w)))
    places = F.create_map(*(F.lit(x) for i, (term, _) in enumerate(terms) for x in (term, f"t{i + 1}")))
    found = F.filter(words_of(text), lambda w: w.isin([t for t, _ in terms]))

    def best(words: Column) -> Column:
        weighed = F.transform(F.array_distinct(words), lambda t: F.struct((-F.round(F.size(F.filter(words, lambda w: w == t)) * weights[t], 9)).alias("less"), places[t].alias("topic")))
        return F.array_min(weighed)["topic"]

    return F.transform(F.array(found), best)[0]  # binds the words found, so that they are found once


def topic_of(text: Column, lang: Column, terms: dict[str, list[tuple[str, float]]]) -> Column:
    """The topic of a text by the terms of its language."""
    lang, out = F.coalesce(lang, F.lit(NONE)), None
    for name in sorted(terms):
        if name:
            topic = leading(text, terms[name])
            out = F.when(lang == name, topic) if out is None else out.when(lang == name, topic)
    rest = leading(text, terms.get("", []))
    return rest if out is None else out.otherwise(rest)


def tokens_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(id_: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def topic_column(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Column:
    """The topic of every row of ``docs``: its own column, or by the terms of all texts."""
    if "topic" in docs.columns:
        return F.col("topic").cast("string")
    return topic_of(F.coalesce(F.col(text_col), F.lit("")), F.col(lang_col), topic_terms(docs, text_col, lang_col))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """id, source, lang, topic, n_tokens of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda c: F.coalesce(c, F.lit(NONE))
    topic = topic_column(docs, text_col, lang_col) if topic is None else topic
    return docs.select(F.col(id_col).alias("id"), named(F.col(source_col)).alias("source"), named(F.col(lang_col)).alias("lang"), named(topic).alias("topic"), tokens_of(text).alias("n_tokens"))


def aimed(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """The cells with the token target of each of their margins (``aim_<dimension>``) and factor 1."""
    total = cells.agg(F.sum("t")).first()[0] or 0.0
    for d in DIMENSIONS:
        margin = cells.groupBy(d).agg(F.sum("t").alias("s"))
        aim = F.pow(F.col("s") / F.lit(total or 1.0), F.lit(powers[d]))
        for value, share in ((targets or {}).get(d) or {}).items():
            aim = F.when(F.col(d) == value, F.lit(float(share))).otherwise(aim)
        margin = margin.select(d, aim.alias(f"aim_{d}"))
        scale = margin.agg(F.sum(f"aim_{d}")).first()[0] or 1.0
        cells = cells.join(margin.select(d, (F.col(f"aim_{d}") / F.lit(scale) * F.lit(total)).alias(f"aim_{d}")), d)
    return materialize(cells.withColumns({"factor": F.lit(1.0), "moved": F.lit(0.0)}), "mix-aimed")


def sweep(cells: DataFrame) -> DataFrame:
    """One pass over the dimensions; ``moved`` is how far the factor of a cell went."""
    before = cells.withColumn("before", F.col("factor"))
    for d in DIMENSIONS:
        sums = before.groupBy(d).agg(F.sum(F.col("t") * F.col("factor")).alias("s"))
        before = before.join(sums, d).withColumn("factor", F.col("factor") * F.col(f"aim_{d}") / F.col("s")).drop("s")
    return materialize(before.withColumn("moved", F.abs(F.col("factor") / F.col("before") - 1)).drop("before"), "mix-sweep")


def sweeps_at_once(cells: DataFrame, times: int) -> DataFrame:
    """The same ``times`` over in one task, for cells that are known to be few."""
    cells = cells.coalesce(1)
    for _ in range(times):
        cells = cells.withColumn("before", F.col("factor"))
        for d in DIMENSIONS:
            s = F.sum(F.col("t") * F.col("factor")).over(Window.partitionBy(d))
            cells = cells.withColumn("s", s).withColumn("factor", F.col("factor") * F.col(f"aim_{d}") / F.col("s"))
    return materialize(cells.withColumn("moved", F.abs(F.col("factor") / F.col("before") - 1)).drop("before", "s"), "mix-sweep")


def rake(rows: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """source, lang, topic, t (tokens), factor and the aims of the raked cells."""
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("t")).filter("t > 0"), "mix-cells")
    counted, cells = cells, aimed(cells, powers, targets)
    release(counted)
    few = cells.count() <= FEW
    for done in range(sweeps, MOST + 1, sweeps):
        for _ in range(1 if few else sweeps):
            before, cells = cells, sweeps_at_once(cells, sweeps) if few else sweep(cells)
            release(before)
        moved = cells.agg(F.max("moved")).first()[0] or 0.0
        if moved <= TOLERANCE:
            break
    else:
        warnings.warn(f"raking did not settle: factors still move by {moved:.2g} after {done} sweeps", stacklevel=2)
    return cells


def probabilities(cells: DataFrame, budget: float, rounds: int = SOLVE) -> DataFrame:
    """The cells with p = min(1, k * factor), expected tokens meeting ``budget`` of all."""
    total, mass = cells.agg(F.sum("t"), F.sum(F.col("t") * F.col("factor"))).first()
    k, before = (budget * total / mass if mass else 0.0), None
    for _ in range(rounds):
        full = F.col("factor") * F.lit(k) >= 1.0
        taken, open_ = cells.agg(F.sum(F.when(full, F.col("t")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("t") * F.col("factor")))).first()
        if not open_ or taken == before:
            break
        k, before = (budget * total - taken) / open_, taken
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("factor") * F.lit(k)))


def margins(fitted: DataFrame) -> DataFrame:
    """dimension, value, aim and got: the target and the expected share of the sample of every margin."""
    parts = [fitted.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg((F.first(f"aim_{d}")).alias("aim"), F.sum(F.col("t") * F.col("p")).alias("got")) for d in DIMENSIONS]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    total, kept = fitted.agg(F.sum("t"), F.sum(F.col("t") * F.col("p"))).first()
    return every.select("dimension", "value", (F.col("aim") / F.lit(total or 1.0)).alias("aim"), (F.col("got") / F.lit(kept or 1.0)).alias("got"))


def fit_mix(rows: DataFrame, budget: float = 0.5, **options) -> DataFrame:
    """source, lang, topic, factor, p for every cell of ``rows`` (see :func:`described`)."""
    return probabilities(rake(rows, **options), budget).select(*DIMENSIONS, "factor", "p")


def mix(docs: DataFrame, budget: float = 0.5, seed: int = 42, id_col: str = "doc_id", **options) -> DataFrame:
    """id, source, lang, topic, n_tokens, factor, probability, sampled for every row."""
    rows = materialize(described(docs, id_col), "mix-rows")
    cells = fit_mix(rows, budget, **options)
    p = F.coalesce(F.col("p"), F.lit(0.0))
    return rows.join(cells, list(DIMENSIONS), "left").select(
        F.col("id").alias(id_col),
        *DIMENSIONS,
        "n_tokens",
        F.round(F.coalesce("factor", F.lit(0.0)), 8).alias("factor"),
        F.round(p, 8).alias("probability"),
        (draw(F.col("id"), seed) < p).alias("sampled"),
    )


def sample_documents(docs: DataFrame, budget: float = 0.5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The sampled rows of ``docs``, all columns; the text is not shuffled."""
    topic = topic_column(docs, text_col)
    cells = fit_mix(described(docs, id_col, text_col, topic=topic), budget, **options).select(*(F.col(d).alias(f"__{d}") for d in DIMENSIONS), F.col("p").alias("__p"))
    keyed = docs.withColumns({"__s": F.coalesce("source", F.lit(NONE)), "__l": F.coalesce("lang", F.lit(NONE)), "__t": F.coalesce(topic, F.lit(NONE)), "__u": draw(F.col(id_col), seed)})
    met = keyed.join(cells, (F.col("__s") == F.col("__source")) & (F.col("__l") == F.col("__lang")) & (F.col("__t") == F.col("__topic")) & (F.col("__u") < F.col("__p")), "left_semi")
    return met.select(*(docs.columns))


def sql(budget: float = 0.5, seed: int = 42, table: str = "documents", sweeps: int = SWEEPS) -> str:
    """The result of :func:`mix` over ``table``, unrolled for DuckDB."""
    out = f"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS body FROM {table}
),
langs AS MATERIALIZED (SELECT lang, CASE WHEN count(*) * {POOL} >= (SELECT count(*) FROM base) THEN lang ELSE '' END AS pool, count(*) AS size FROM base GROUP BY lang),
pools AS MATERIALIZED (SELECT pool, sum(size)::DOUBLE AS size FROM langs GROUP BY pool),
words AS MATERIALIZED (SELECT r, lang, unnest(regexp_extract_all(lower(body), '{WORD}')) AS term FROM base),
held AS MATERIALIZED (SELECT r, pool, term, count(*) AS c FROM words JOIN langs USING (lang) GROUP BY r, pool, term),
terms AS MATERIALIZED (SELECT pool, term, ln(size / n) AS w, row_number() OVER (PARTITION BY pool ORDER BY n DESC, term) AS k
  FROM (SELECT pool, term, count(*) AS n FROM held GROUP BY pool, term) JOIN pools USING (pool) WHERE 2 * n <= size AND n > 1),
topics AS MATERIALIZED (SELECT r, 't' || k AS topic FROM (SELECT r, k, row_number() OVER (PARTITION BY r ORDER BY round(c * w, 9) DESC, k) AS place
  FROM held JOIN terms USING (pool, term) WHERE k <= {TERMS}) WHERE place = 1),
d AS MATERIALIZED (
  SELECT doc_id, source, lang, coalesce(topic, '{NONE}') AS topic,
         CAST(len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM base LEFT JOIN topics USING (r)
),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
tot AS MATERIALIZED (SELECT sum(t) AS total FROM cells)"""
    for x in DIMENSIONS:
        out += f""",
m_{x} AS MATERIALIZED (SELECT {x}, pow(sum(t) / (SELECT total FROM tot), {POWERS[x]}) AS a FROM cells GROUP BY {x}),
aim_{x} AS MATERIALIZED (SELECT {x}, a / (SELECT sum(a) FROM m_{x}) * (SELECT total FROM tot) AS aim FROM m_{x}),
f_{x}_0 AS MATERIALIZED (SELECT {x}, 1.0::DOUBLE AS f FROM m_{x})"""
    at = dict.fromkeys(DIMENSIONS, 0)
    for _ in range(sweeps):
        for x in DIMENSIONS:
            a, b = (y for y in DIMENSIONS if y != x)
            out += f""",
f_{x}_{at[x] + 1} AS MATERIALIZED (
  SELECT {x}, any_value(aim) / sum(t * fa.f * fb.f) AS f
  FROM cells JOIN f_{a}_{at[a]} fa USING ({a}) JOIN f_{b}_{at[b]} fb USING ({b}) JOIN aim_{x} USING ({x}) GROUP BY {x})"""
            at[x] += 1
    out += f""",
raked AS MATERIALIZED (SELECT source, lang, topic, t, fs.f * fl.f * ft.f AS factor FROM cells
  JOIN f_source_{sweeps} fs USING (source) JOIN f_lang_{sweeps} fl USING (lang) JOIN f_topic_{sweeps} ft USING (topic)),
k_0 AS MATERIALIZED (SELECT {budget} * sum(t) / sum(t * factor) AS k FROM raked)"""
    for i in range(SOLVE):
        out += f""",
k_{i + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce(sum(t * factor) FILTER (factor * (SELECT k FROM k_{i}) < 1), 0) = 0 THEN (SELECT k FROM k_{i})
  ELSE ({budget} * sum(t) - coalesce(sum(t) FILTER (factor * (SELECT k FROM k_{i}) >= 1), 0)) / sum(t * factor) FILTER (factor * (SELECT k FROM k_{i}) < 1) END AS k FROM raked)"""
    return out + f""",
scored AS (SELECT d.*, coalesce(factor, 0) AS f, coalesce(least(1.0, factor * (SELECT k FROM k_{SOLVE})), 0) AS p,
  CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM d LEFT JOIN raked USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(f, 8) AS factor, round(p, 8) AS probability, u < p AS sampled FROM scored
"""


SQL = sql()


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
