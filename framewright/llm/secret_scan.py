"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong candidates stand by themselves: assignments (``assign``), access
identifiers (``access``) and long hex runs (``hex``). Weak candidates are
reported only where complementary parts co-occur within a scope: an identifier
(``user``), a secret-like run of mixed characters (``blob``) or an endpoint
(``host``). Two parts complement each other if one is an identifier, one a
secret, or one an endpoint and the other a secret, and at most ``scope``
characters lie between them. The link is an interval join: candidates are laid
on tiles of ``scope`` characters, joined on (row, tile), and kept by a semi join
on the gap; no pair is ever emitted, and a tile holds a bounded number of
candidates however long the text is.

Spans are found by splitting the text at the matches: the lengths of the gaps
and of the matches give every offset in code points. The running sums are taken
in blocks, so the work in a text is in proportion to its matches. A row is
searched for a pattern only if it holds what the pattern needs (a literal, or a
long run of characters), and for weak parts only if it has a secret at all, for
every link has one.

Defined results: null text has no spans; offsets are code points, end
exclusive; spans sort by start, then kind in the order assign, access, hex,
user, blob, host, then end; a weak candidate that overlaps a strong one of its
own role is not repeated. Rows are kept apart even where ids repeat: each row of
an id gets the spans of its own text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.runtime import materialize

# The base patterns. Where a minimum length cannot change which
# matches come next (greedy runs of one class), it is part of the pattern.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts.
USER = r"""(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_[iI][dD]|[aA][cC][cC][eE][sS][sS]_[kK][eE][yY]_[iI][dD])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=@-]{3,}"""
BLOB = r"[A-Za-z0-9+/]{32,}={0,2}"
HOST = r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._:@-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?"
KINDS = ("assign", "access", "hex", "user", "blob", "host")
# Roles: identifier, secret, endpoint.
RUN = r"[A-Za-z0-9+/]{24}"  # no hex run and no blob without it
IN_URL = r"[0-9]\.[0-9]|://"  # no endpoint without one of these
ROLE = {"assign": "s", "access": "i", "hex": "s", "user": "i", "blob": "s", "host": "e"}
SCOPE = 256
BLOCK = 128
EMPTY = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start,kind,end>> of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, _lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    sizes = F.transform(found, lambda m: F.length(m))
    return _place(gaps, sizes, F.transform(found, lambda m: F.lit(True)), kind)


def assign_spans(text: Column) -> Column:
    """The same for assignments, dropping those whose value is under six characters."""
    heads = F.regexp_extract_all(text, _lit(ASSIGN), F.lit(1))
    values = F.regexp_extract_all(text, _lit(ASSIGN), F.lit(2))
    gaps = F.transform(F.split(text, ASSIGN, -1), lambda g: F.length(g))
    sizes = F.zip_with(heads, values, lambda h, v: F.length(h) + F.length(v))
    return _place(gaps, sizes, F.transform(values, lambda v: F.length(v) >= 6), 0)


def _place(gaps: Column, sizes: Column, good: Column, kind: int) -> Column:
    """Spans from the lengths of gaps and matches: running sums over blocks, then within each."""
    parts = F.zip_with(F.slice(gaps, 1, F.size(sizes)), F.zip_with(sizes, good, lambda s, g: F.struct(s.alias("size"), g.alias("good"))), lambda gap, m: F.struct(gap.alias("gap"), m["size"].alias("size"), m["good"].alias("good")))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + m["size"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["good"], F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    def in_blocks(all_parts: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_parts), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda i: F.slice(all_parts, i, BLOCK))
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, m: n + m["gap"] + m["size"]))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda found, n: F.concat(found, F.array(F.element_at(found, -1) + n)))
        placed = F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.expr(EMPTY).alias("spans")), step)["spans"])
        return F.flatten(placed)

    return F.transform(F.array(parts), in_blocks)[0]  # binds the parts, so that they are made once


def _written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (strong spans, sorted) and weak (weak spans, sorted) of every row."""
    empty = F.expr(EMPTY)
    text = F.col("body")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    keyed = (text.contains("=") | text.contains(":")) & text.rlike(ASSIGN)
    long = text.rlike(RUN)
    strong = F.concat(
        F.when(keyed, assign_spans(text)).otherwise(empty),
        F.when(text.contains("AKIA"), spans(text, ACCESS, 1)).otherwise(empty),
        F.when(F.col("long"), spans(text, HEX, 2)).otherwise(empty),
    )
    first = rows.withColumn("long", long)
    first = first.select("id", "body", F.array_sort(strong).alias("base"), F.when(F.col("long"), spans(text, BLOB, 4)).otherwise(empty).alias("blobs"))
    secret = (F.size("blobs") > 0) | F.exists("base", lambda s: s["kind"] != 1)
    other = F.concat(
        "blobs",
        F.when(text.contains("=") | text.contains(":"), spans(text, USER, 3)).otherwise(empty),
        F.when(text.rlike(IN_URL), spans(text, HOST, 5)).otherwise(empty),
    )
    return first.select("id", "base", F.when(secret, F.array_sort(other)).otherwise(empty).alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, span: the weak spans whose complement lies within ``scope`` characters."""
    roles = F.array(*(F.lit(ROLE[k]) for k in KINDS))
    parts = found.filter(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("span")).select("row", "span", F.element_at(roles, F.col("span.kind") + 1).alias("role"))
    tile = lambda at: F.floor(at / scope)
    weak = parts.filter("span.kind >= 3").withColumn("tile", F.explode(F.sequence(tile(F.col("span.start")) - 1, tile(F.col("span.end")) + 1)))
    other = parts.select(F.col("row").alias("r"), F.col("span").alias("o"), F.col("role").alias("orole"), F.explode(F.sequence(tile(F.col("span.start")), tile(F.col("span.end")))).alias("t"))
    meets = (F.col("row") == F.col("r")) & (F.col("tile") == F.col("t"))
    complement = F.concat("role", "orole").isin("is", "si", "es", "se")
    apart = F.greatest(F.col("o.start") - F.col("span.end"), F.col("span.start") - F.col("o.end"))
    hit = weak.join(other, meets & complement & (apart >= 0) & (apart <= scope), "left_semi").select("row", "span").distinct()
    # the same part seen by a strong pattern is reported there already
    same = (F.col("role") == F.col("orole")) & (F.col("o.start") < F.col("span.end")) & (F.col("span.start") < F.col("o.end"))
    covered = weak.join(other.filter("o.kind < 3"), meets & same, "left_semi").select("row", "span").distinct()
    return hit.join(covered, ["row", "span"], "left_anti").groupBy("row").agg(F.collect_set("span").alias("more"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    found = materialize(candidates(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    more = linked(found, scope)
    joined = found.join(more, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.expr(EMPTY))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(every).alias("spans"),
    )


def _sql_spans(name: str, kind: int, pattern: str, group: str | None = None) -> str:
    quoted = pattern.replace("'", "''")
    found = f"regexp_extract_all(body, '{quoted}')"
    value = f"regexp_extract_all(body, '{quoted}', 2)" if group else found
    return f"""
{name} AS (
  SELECT doc_id, {kind} AS kind, start, start + size AS stop FROM (
    SELECT doc_id, size, good, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY k) - size AS start FROM (
      SELECT doc_id, unnest(range(1, len(found) + 1)) AS k, length(unnest(found)) AS size,
             unnest(list_transform(gaps[1:len(found)], lambda g: length(g))) AS gap,
             unnest(list_transform(vals, lambda v: length(v) >= {6 if group else 0})) AS good
      FROM (SELECT doc_id, {found} AS found, {value} AS vals, string_split_regex(body, '{quoted}') AS gaps FROM d)
    )
  ) WHERE good
)"""


def _sql(scope: int = SCOPE) -> str:
    ctes = ",".join(_sql_spans(n, k, p, g) for n, k, p, g in (("s_assign", 0, ASSIGN, "v"), ("s_access", 1, ACCESS, None), ("s_hex", 2, HEX, None), ("s_user", 3, USER, None), ("s_blob", 4, BLOB, None), ("s_host", 5, HOST, None)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),{ctes},
spans AS (
  SELECT doc_id, kind, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
         ['s', 'i', 's', 'i', 's', 'e'][kind + 1] AS role,
         ['assign', 'access', 'hex', 'user', 'blob', 'host'][kind + 1] AS name
  FROM (SELECT * FROM s_assign UNION ALL SELECT * FROM s_access UNION ALL SELECT * FROM s_hex
        UNION ALL SELECT * FROM s_user UNION ALL SELECT * FROM s_blob UNION ALL SELECT * FROM s_host)
),
kept AS (
  SELECT * FROM spans WHERE kind < 3
  UNION ALL
  SELECT w.* FROM spans w WHERE w.kind >= 3
    AND EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = w.doc_id AND (w.role || o.role) IN ('is', 'si', 'es', 'se')
                AND greatest(o.start - w.stop, w.start - o.stop) BETWEEN 0 AND {scope})
    AND NOT EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = w.doc_id AND o.kind < 3 AND o.role = w.role
                    AND o.start < w.stop AND w.start < o.stop)
),
summed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
         coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '') AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS every
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN summed USING (doc_id)
"""


SQL = _sql()


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
