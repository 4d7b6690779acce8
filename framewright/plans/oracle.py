"""The registered queries as SQL for DuckDB, written apart from the operators."""

from __future__ import annotations

ALPHABET = "abcdefghijklmnopqrstuvwxyzàâçèéêëîïôöüßñ"

PROBES = """probes AS (
  SELECT doc_id AS row_id, lang AS label, source, array_to_string(list_transform(string_split_regex('{abc}', ''),
    lambda c: CASE WHEN length(text) < 200 THEN 'U' WHEN instr(lower(text), c) > 0 THEN '1' ELSE '0' END), '') AS concatenated
  FROM documents)""".format(abc=ALPHABET)

POSITIONS = f"""{PROBES},
long AS (SELECT row_id, label, unnest(range(0, 40)) AS pos, unnest(string_split_regex(concatenated, '')) AS symbol FROM probes)"""


def _entropy(keys: str) -> str:
    return f"""SELECT {keys}pos, abs(sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(3)) AS h FROM (
  SELECT {keys}pos, c::DOUBLE / sum(c) OVER (PARTITION BY {keys}pos) AS p FROM (SELECT {keys}pos, symbol, count(*) AS c FROM long GROUP BY {keys}pos, symbol)) GROUP BY {keys}pos"""


SUITABLE = f"""{POSITIONS},
v AS ({_entropy("")}),
s AS (SELECT pos, avg(1 - h) AS s FROM ({_entropy("label, ")}) GROUP BY pos),
suit AS (SELECT pos, h AS v, s, CASE WHEN round(s, 12) >= 0.8 THEN h ELSE 0 END AS u FROM v JOIN s USING (pos))"""

MASKS = """masks AS (
  SELECT CASE WHEN block = 8 THEN 0 ELSE 15 END + 3 * (start // block) + kind AS filter_id, start, block, kind,
         repeat('0', start) || repeat(CASE WHEN kind = 0 THEN 'N' ELSE '1' END, block // 2) || repeat(CASE WHEN kind = 1 THEN 'N' ELSE '1' END, block // 2) || repeat('0', 40 - start - block) AS Bitmask
  FROM (SELECT unnest([8, 16]) AS block) b, range(0, 40, 8) s(x), range(0, 3) k(kind), LATERAL (SELECT x AS start) t
  WHERE start % block = 0 AND start + block <= 40)"""

SIGNS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE -1 END) AS s FROM embeddings),
near AS (SELECT a.vec_id AS item1, b.vec_id AS item2, CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS equality, a.s AS s1, b.s AS s2
  FROM v a JOIN v b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 7),
dist AS (SELECT item1, item2, equality, len(list_filter(range(1, 65), lambda i: s1[i] <> s2[i])) AS d FROM near)"""

CURVE = f"""{SIGNS},
bins AS (SELECT d, count(*) FILTER (equality = 1) AS p, count(*) FILTER (equality <> 1) AS q FROM dist GROUP BY d),
cum AS (SELECT d, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq,
  lag(d) OVER w AS before, lead(d) OVER w AS after, lead(p) OVER w AS p2, lead(q) OVER w AS q2 FROM bins WINDOW w AS (ORDER BY d)),
curve AS (SELECT d, tp, fp, fp / nq AS fpr, tp / np AS tpr FROM cum WHERE before IS NULL OR after IS NULL OR p <> p2 OR q <> q2)"""


def _sampled(draws: str) -> str:
    """CTEs ``chosen`` (draw, label, row_id, pos) from a table of draws (draw, label, n)."""
    return f"""
draws AS ({draws}),
counts AS (SELECT label, concatenated AS value, count(*) AS m FROM probes GROUP BY ALL),
totals AS (SELECT label, count(*) AS total FROM probes GROUP BY ALL),
share AS (SELECT draw, label, value, m, (m * n) // total AS k0, (m * n) % total AS remainder, n FROM draws JOIN totals USING (label) JOIN counts USING (label)),
ranked AS (SELECT *, n - sum(k0) OVER (PARTITION BY draw, label) AS missing, row_number() OVER (PARTITION BY draw, label ORDER BY remainder DESC, value) AS r FROM share),
alloc AS (SELECT draw, label, value, m, k0 + CASE WHEN r <= missing THEN 1 ELSE 0 END AS k FROM ranked),
numbered AS (SELECT label, concatenated AS value, row_id, row_number() OVER (PARTITION BY label, concatenated ORDER BY md5('42:' || row_id), row_id) - 1 AS rn FROM probes),
picks AS (SELECT draw, label, value, m, k, unnest(range(1, k + 1)) AS i FROM alloc WHERE k > 0),
turns AS (SELECT draw, label, value, CASE WHEN k <= m THEN 0 ELSE i END AS copy,
  CASE WHEN k <= m THEN CAST('0x' || substr(md5('42:' || draw || ':' || label || ':' || value), 1, 8) AS BIGINT) + i
  ELSE CAST('0x' || substr(md5('42:' || draw || ':' || label || ':' || value || ':' || i), 1, 8) AS BIGINT) END % m AS rn FROM picks),
picked AS (SELECT draw, label, row_id, copy FROM turns JOIN numbered USING (label, value, rn)),
chosen AS (SELECT draw, label, row_id, row_number() OVER (PARTITION BY draw, label ORDER BY md5('42:' || draw || ':' || row_id || ':' || copy), row_id, copy) AS pos FROM picked)"""


PAIRS = f"""WITH {PROBES},
labels AS (SELECT DISTINCT label FROM probes),
partners AS (SELECT a.label, b.label AS partner, row_number() OVER (PARTITION BY a.label ORDER BY md5('42:' || a.label || ':' || b.label), b.label) AS turn,
  count(*) OVER (PARTITION BY a.label) AS others FROM labels a JOIN labels b ON a.label <> b.label),
{_sampled('''SELECT 'same|' || label AS draw, label, 200 AS n FROM labels UNION ALL SELECT 'left|' || label, label, 100 FROM labels
  UNION ALL SELECT 'right|' || label || '|' || partner, partner, 100 // others + CASE WHEN turn <= 100 % others THEN 1 ELSE 0 END FROM partners''')},
sides AS (SELECT split_part(draw, '|', 2) AS owner, label AS device2, row_id AS item2, row_number() OVER (PARTITION BY split_part(draw, '|', 2)
  ORDER BY md5('42:' || split_part(draw, '|', 2) || ':' || label || ':' || row_id || ':' || pos), label, row_id, pos) AS at FROM chosen WHERE draw LIKE 'right|%')
SELECT a.row_id AS item1, b.row_id AS item2, a.label AS device1, a.label AS device2, 1 AS equality
FROM chosen a JOIN chosen b ON a.draw = b.draw AND b.pos = a.pos + 100 WHERE a.draw LIKE 'same|%' AND a.pos <= 100
UNION ALL
SELECT c.row_id, s.item2, c.label, s.device2, -1 FROM chosen c JOIN sides s ON s.owner = c.label AND s.at = c.pos WHERE c.draw LIKE 'left|%'
"""

EQUAL = f"""{PROBES},
sizes AS (SELECT concatenated, count(*) AS n, min(row_id) AS first FROM probes GROUP BY 1),
big AS (SELECT concatenated, row_number() OVER (ORDER BY first) - 1 AS cluster FROM sizes WHERE n >= 6),
assigned AS (SELECT row_id, label, concatenated, coalesce(cluster, -1) AS cluster FROM probes LEFT JOIN big USING (concatenated))"""

COMBS = """labels AS (SELECT DISTINCT label FROM probes),
subsets AS (SELECT list_sort(list(l.label)) AS members, bits FROM range(1, (1 << (SELECT count(*) FROM labels))::BIGINT) r(bits),
  (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM labels) l WHERE (bits >> i) & 1 = 1 GROUP BY bits),
combs AS (SELECT bits AS comb, len(members) AS length, members FROM subsets WHERE len(members) >= 2)"""


def _agree(source: str, keys: str, name: str = "agree") -> str:
    """CTE with h, c, v and ari for each value of ``keys`` of ``source`` (keys, label, cluster)."""
    return f"""
{name}_n AS (SELECT {keys}, label, cluster, count(*) AS n FROM {source} GROUP BY ALL),
{name}_m AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS nn, sum(n) OVER (PARTITION BY {keys}, label) AS a, sum(n) OVER (PARTITION BY {keys}, cluster) AS b FROM {name}_n),
{name}_e AS (SELECT {keys}, any_value(nn) AS nn, sum(n / nn * ln(nn * n / (a * b))) AS mi, -sum(n / nn * ln(a / nn)) AS ha, -sum(n / nn * ln(b / nn)) AS hb,
  sum(n * (n - 1) / 2) AS same, sum(n / a * a * (a - 1) / 2) AS sa, sum(n / b * b * (b - 1) / 2) AS sb FROM {name}_m GROUP BY ALL),
{name}_h AS (SELECT *, CASE WHEN abs(ha) < 1e-12 THEN 1 ELSE mi / ha END AS h, CASE WHEN abs(hb) < 1e-12 THEN 1 ELSE mi / hb END AS c, sa * sb / (nn * (nn - 1) / 2) AS expected FROM {name}_e),
{name} AS (SELECT *, CASE WHEN h + c < 1e-12 THEN 0 ELSE 2 * h * c / (h + c) END AS v,
  CASE WHEN abs((sa + sb) / 2 - expected) < 1e-12 THEN 1 ELSE (same - expected) / ((sa + sb) / 2 - expected) END AS ari FROM {name}_h)"""


GRID = f"""{PROBES}, {COMBS},
kept AS (SELECT * FROM combs WHERE length IN (SELECT length FROM (SELECT length, row_number() OVER (ORDER BY length) AS t FROM (SELECT DISTINCT length FROM combs)) WHERE t % 2 = 1)),
spread AS (SELECT comb, length, eps, min_samples, row_id, label, concatenated FROM kept JOIN probes ON list_contains(members, label),
  (SELECT unnest([1e-5, 1e-2]) AS eps) e, (SELECT unnest([2, 6]) AS min_samples) m),
put AS (SELECT comb, length, eps, min_samples, label, CASE WHEN count(*) OVER (PARTITION BY comb, eps, min_samples, concatenated) >= min_samples THEN concatenated ELSE '-1' END AS cluster FROM spread),
{_agree("put", "comb, length, eps, min_samples")},
grid AS (SELECT length, eps, min_samples, count(*) AS n_combinations, avg(v) AS v_measure FROM agree GROUP BY ALL)"""

FIRST_SUMS = """
scored AS (SELECT row_id, label, filter_id, block,
  (CASE WHEN kind = 0 THEN -1 ELSE 1 END) * len(replace(replace(substr(concatenated, start + 1, block // 2), '0', ''), 'U', ''))
  + (CASE WHEN kind = 1 THEN -1 ELSE 1 END) * len(replace(replace(substr(concatenated, start + block // 2 + 1, block // 2), '0', ''), 'U', '')) AS score FROM probes, masks)"""


CAPTURED = """docs AS (SELECT doc_id AS i, coalesce(lang, 'none') || '-' || (doc_id // 500) AS name, sha256(coalesce(text, '')) AS sha, md5(coalesce(text, '')) AS md FROM documents),
captured AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS packet, '02:' || regexp_replace(lower(lpad(to_hex(i), 10, '0')), '(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5') AS mac FROM docs)"""


def _high_first(h: str) -> str:
    """Bits of hex text, the most significant of each byte first."""
    return f"array_to_string(list_transform(range(0, len({h}) // 2), lambda q: right('00000000' || bin(CAST('0x' || substr({h}, (2 * q + 1)::BIGINT, 2) AS BIGINT)), 8)), '')"


def _ht_bits(h: str) -> str:
    """The bits of an HT element in hex, the bytes of each group turned round; null if it is too short."""
    from framewright.operators.decode import HT_GROUPS

    parts, at = [], 0
    for size, _ in HT_GROUPS:
        parts += [f"substr({h}, {2 * (at + size - 1 - i) + 1}, 2)" for i in range(size)]
        at += size
    return f"CASE WHEN len({h}) >= {2 * at} THEN {_high_first('(' + ' || '.join(parts) + ')')} END"


def _number(bits: str) -> str:
    """Bit text of up to 62 digits as a whole number."""
    return f"list_sum(list_transform(range(0, len({bits})), lambda i: CASE WHEN substr({bits}, (i + 1)::BIGINT, 1) = '1' THEN 1::BIGINT << (len({bits}) - 1 - i)::INTEGER ELSE 0 END))"


def _ht_fields(bits: str = "bits") -> str:
    from framewright.operators.decode import HT_GROUPS

    out, at = [], 1
    for name, width in (f for _, fields in HT_GROUPS for f in fields):
        if width < 63:
            value = f"({_number(f'substr({bits}, {at}, {width})')})::VARCHAR"
        else:
            value = f"(({_number(f'substr({bits}, {at}, {width - 32})')})::HUGEINT * 4294967296 + ({_number(f'substr({bits}, {at + width - 32}, 32)')})::HUGEINT)::VARCHAR"
        out.append(f'CASE WHEN {bits} IS NOT NULL THEN {value} END AS "{name}"')
        at += width
    return ", ".join(out)


def _binary_columns() -> str:
    """The 30 columns of the binary table for the made captures."""
    filled = {"ssid": ("ssid", 0, 32, "lower(hex(encode(md)))"), "supported_rates": ("sup_rates", 1, 4, "'02040b16'"), "dsss_parameter": ("dsss", 3, 1, "lpad(to_hex(i % 11 + 1), 2, '0')"),
              "ht_cap": ("ht_cap", 45, 26, "substr(sha, 1, 52)"), "ext_cap": ("ext_cap", 127, 9, "substr(sha, 47, 18)"), "vst": ("vst", 221, 16, "sha || 'dd10' || md"), "ext_tags": ("ext_tags", 255, 7, "'23' || substr(md, 1, 12)")}
    out = ["mac"]
    for name, (suffix, kind, size, h) in filled.items():
        out += [f"'{kind:08b}' AS e_id_{suffix}", f"'{size:08b}' AS len_{suffix}", f"{_high_first(f'({h})')} AS {name}"]
    out += [f"'' AS {p}{s}" for s in ("ext_sup_rates", "vht_cap") for p in ("e_id_", "len_", "")]
    return ", ".join([*out, f"{_high_first('substr(md, 25, 8)')} AS frame_check_seq"])


def _boosted(length: int = 40) -> str:
    """All rounds of boosting unrolled, until the filters run out: a table ``model``."""
    rounds = 3 * (length // 8 + length // 16)
    out = f"""WITH {PROBES}, {MASKS}, {FIRST_SUMS},
pairs AS (SELECT row_number() OVER () AS pair, a.row_id AS item1, b.row_id AS item2, CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS y FROM probes a JOIN probes b ON b.row_id BETWEEN a.row_id + 1 AND a.row_id + 3),
scored2 AS MATERIALIZED (SELECT * FROM scored),
sides AS MATERIALIZED (SELECT pair, y, s.filter_id, s.block AS width, least(s.score, z.score) AS lo, greatest(s.score, z.score) AS hi FROM pairs JOIN scored2 s ON s.row_id = item1 JOIN scored2 z ON z.row_id = item2 AND z.filter_id = s.filter_id),
told AS MATERIALIZED (SELECT pair, y, filter_id, unnest(range(greatest(lo, 1), least(hi - 1, width) + 1)) AS threshold FROM sides WHERE lo < hi),
every AS MATERIALIZED (SELECT filter_id, block AS width, unnest(range(1, block + 1)) AS threshold FROM masks),
w_1 AS MATERIALIZED (SELECT pair, y, 1.0::DOUBLE AS w FROM pairs)"""
    chosen = []
    for r in range(1, rounds + 1):
        chosen.append(f"best_{r}")
        used = "".join(f" AND filter_id <> (SELECT filter_id FROM best_{k})" for k in range(1, r))
        out += f""",
err_{r} AS (SELECT filter_id, threshold, sum(t.y * w) AS yw FROM told t JOIN w_{r} USING (pair) GROUP BY filter_id, threshold),
best_{r} AS MATERIALIZED (SELECT {r} AS round, filter_id, threshold, width, CASE WHEN e > 0 THEN e ELSE 1e-20 END AS e FROM (
  SELECT filter_id, threshold, width, ((SELECT sum(w) FROM w_{r} WHERE y = -1) + coalesce(yw, 0)) / (SELECT sum(w) FROM w_{r}) AS e FROM every LEFT JOIN err_{r} USING (filter_id, threshold) WHERE true{used})
  ORDER BY round(e, 12), width, threshold, filter_id LIMIT 1),
w_{r + 1} AS MATERIALIZED (SELECT w.pair, w.y, w / (SELECT sum(w) FROM w_{r}) * CASE WHEN w.y = 1 AND t.pair IS NOT NULL THEN (SELECT (1 - e) / e FROM best_{r}) ELSE 1 END AS w
  FROM w_{r} w LEFT JOIN (SELECT told.pair FROM told JOIN best_{r} USING (filter_id, threshold)) t USING (pair))"""
    united = " UNION ALL ".join(f"SELECT * FROM {c}" for c in chosen)
    return out + f""",
model AS (SELECT round::INTEGER AS round, filter_id::INTEGER AS filter_id, Bitmask, start, block, threshold::INTEGER AS threshold, width::INTEGER AS width, e AS min_error, ln((1 - e) / e) AS confidence
  FROM ({united}) JOIN masks USING (filter_id))"""


def _dense(kept: str, eps: str, least: str) -> str:
    """Density clusters of the parts' byte sums within combinations of their types: CTEs ``put`` and ``agree``."""
    g = "comb, length, eps, least"
    return f"""raw AS (SELECT p_partkey AS row_id, p_type AS label, ({_byte_sum("hex(encode(p_name))")})::DOUBLE AS x, ({_byte_sum("hex(encode(p_brand))")})::DOUBLE AS y FROM part),
probes AS (SELECT row_id, label, (x - x0) / (x1 - x0) AS a, (y - y0) / (y1 - y0) AS b FROM raw, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM raw)),
{COMBS},
kept AS ({kept}),
points AS (SELECT {g}, row_id, label, a, b FROM kept JOIN probes ON list_contains(members, label), (SELECT unnest({eps}) AS eps) e, (SELECT unnest({least}) AS least) m),
spots AS (SELECT {g}, a, b, count(*) AS n, min(row_id) AS spot FROM points GROUP BY ALL),
l AS (SELECT s.comb, s.length, s.eps, s.least, s.spot AS spot, o.spot AS other, o.n AS n2 FROM spots s JOIN spots o ON s.comb = o.comb AND s.eps = o.eps AND s.least = o.least AND abs(s.a - o.a) + abs(s.b - o.b) <= s.eps),
core AS (SELECT {g}, spot FROM l GROUP BY ALL HAVING sum(n2) >= least),
inner_ AS (SELECT l.comb, l.eps, l.least, l.spot, l.other FROM l JOIN core c ON c.comb = l.comb AND c.eps = l.eps AND c.least = l.least AND c.spot = l.spot JOIN core k ON k.comb = l.comb AND k.eps = l.eps AND k.least = l.least AND k.spot = l.other),
reach AS (SELECT comb, eps, least, spot, spot AS other FROM core UNION SELECT r.comb, r.eps, r.least, r.spot, i.other FROM reach r JOIN inner_ i ON i.comb = r.comb AND i.eps = r.eps AND i.least = r.least AND i.spot = r.other),
root AS (SELECT comb, eps, least, spot, min(other) AS root FROM reach GROUP BY ALL),
border AS (SELECT l.comb, l.eps, l.least, l.spot, min(root) AS root FROM l JOIN root r ON r.comb = l.comb AND r.eps = l.eps AND r.least = l.least AND r.spot = l.other GROUP BY ALL),
put AS (SELECT p.comb, p.length, p.eps, p.least, p.label, coalesce(r.root, d.root, -1) AS cluster FROM points p JOIN spots s ON s.comb = p.comb AND s.eps = p.eps AND s.least = p.least AND s.a = p.a AND s.b = p.b
  LEFT JOIN root r ON r.comb = s.comb AND r.eps = s.eps AND r.least = s.least AND r.spot = s.spot LEFT JOIN border d ON d.comb = s.comb AND d.eps = s.eps AND d.least = s.least AND d.spot = s.spot),
{_agree("put", g)}"""


def _ext_fields(bits: str = "bits") -> str:
    from framewright.operators.decode import EXTENDED_CAPABILITIES

    where: dict[str, list[int]] = {}
    for at, name in enumerate(EXTENDED_CAPABILITIES):
        where.setdefault(name, []).append(at)
    parts = []
    for name, at in list(where.items())[:72]:
        bit = " || ".join(f"CASE WHEN len({bits}) > {i} THEN substr({bits}, {i + 1}, 1) ELSE '0' END" for i in at)
        parts.append(f"CASE WHEN len({bits}) > {at[0]} THEN {bit} END AS \"{name}\"")
    return ", ".join(parts)


def _bits(expression: str) -> str:
    """Bits of hex text, the least significant of each byte first."""
    return f"array_to_string(list_transform(range(0, len({expression}) // 2), lambda i: reverse(right('00000000' || bin(CAST('0x' || substr({expression}, (2 * i + 1)::BIGINT, 2) AS BIGINT)), 8))), '')"


def _top(k: int) -> str:
    return f"""WITH {SUITABLE}
SELECT row_number() OVER (ORDER BY round(u, 12) DESC, pos)::INTEGER AS rank, pos::INTEGER AS "Index" FROM suit QUALIFY row_number() OVER (ORDER BY round(u, 12) DESC, pos) <= {k}"""


def _byte_sum(h: str) -> str:
    return f"CASE WHEN {h} = '' THEN 0 WHEN regexp_full_match({h}, '[0-9a-fA-F]*') THEN list_sum(list_transform(range(0, (len({h}) + 1) // 2), lambda i: TRY_CAST('0x' || substr({h}, (2 * i + 1)::BIGINT, 2) AS BIGINT)))::BIGINT END"


_NAMES = ("homogeneity", "completeness", "v_measure", "ari", "nmi")
_VALUES = ("h", "c", "v", "ari", "v")

ORACLE_SQL: dict[str, str] = {
    "device_distribution": f"WITH {PROBES} SELECT label, count(*) AS n_rows, count(DISTINCT concatenated) AS n_distinct FROM probes GROUP BY label",
    "non_randomizing_labels": "SELECT l_orderkey AS label FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1",
    "clean_filter": "SELECT event_id, event_type AS mac FROM events WHERE event_type IS DISTINCT FROM 'click'",
    "pad_concat": """SELECT p_partkey, rpad(coalesce(p_name, ''), a, 'U') || rpad(coalesce(p_brand, ''), b, 'U') || rpad(coalesce(p_type, ''), c, 'U') AS concatenated
FROM part, (SELECT max(length(coalesce(p_name, 'nan')))::INTEGER AS a, max(length(coalesce(p_brand, 'nan')))::INTEGER AS b, max(length(coalesce(p_type, 'nan')))::INTEGER AS c FROM part)""",
    "zero_twin": f"WITH {PROBES} SELECT row_id, replace(concatenated, 'U', '0') AS concatenated FROM probes",
    "length_summary": f"WITH {PROBES} SELECT max(length(concatenated))::INTEGER AS max_length, avg(length(concatenated)) AS mean_length FROM probes",
    "bitmask_filters": f"WITH {MASKS} SELECT filter_id::INTEGER AS filter_id, start::INTEGER AS start, block::INTEGER AS block, kind::INTEGER AS kind, Bitmask FROM masks",
    "filter_labels": f"""WITH {MASKS} SELECT filter_id::INTEGER AS filter_id, '0[' || start || '] ' || translate(substr(Bitmask, start + 1, block), '1N', 'xo') || ' 0[' || (40 - start - block) || ']' AS fancy FROM masks""",
    "filter_geometry": f"WITH {MASKS} SELECT filter_id::INTEGER AS filter_id, Bitmask, block::INTEGER AS used, start::INTEGER AS first_used FROM masks",
    "burst_split": """SELECT event_id, user_id, sum(down) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS burst_id FROM (
SELECT *, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS down FROM events)""",
    "probe_count_window": """SELECT user_id, (sum(down) + 1)::BIGINT AS n_bursts, count(*) AS n_rows FROM (
SELECT *, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS down FROM events) GROUP BY user_id""",
    "bit_pdf": f"""WITH {POSITIONS} SELECT pos::INTEGER AS pos, round(avg((symbol = '0')::INTEGER), 10) AS p0, round(avg((symbol = '1')::INTEGER), 10) AS p1, round(avg((symbol = 'U')::INTEGER), 10) AS pu FROM long GROUP BY pos""",
    "bit_entropy": f"WITH {POSITIONS} SELECT pos::INTEGER AS pos, round(h, 10) AS h FROM ({_entropy('')})",
    "label_entropy": f"WITH {POSITIONS} SELECT label, pos::INTEGER AS pos, round(h, 10) AS h FROM ({_entropy('label, ')})",
    "suitability": f"WITH {SUITABLE} SELECT pos::INTEGER AS pos, round(v, 9) AS v, round(s, 9) AS s, round(u, 9) AS u FROM suit",
    **{f"pf_topk_{k}": _top(k) for k in (8, 16, 32)},
    "position_threshold": f"""WITH {SUITABLE}, o AS (SELECT u, row_number() OVER (ORDER BY u DESC, pos) AS r FROM suit)
SELECT r::INTEGER AS num_bits, greatest(0.0, 1 - 0.001 * ceil(round((1 - u) / 0.001, 9))) AS threshold FROM o WHERE r IN (8, 16)""",
    "balanced_resample": f"WITH {PROBES}, {_sampled('''SELECT DISTINCT 'all' AS draw, label, 200 AS n FROM probes''')} SELECT label, row_id, pos::INTEGER AS pos FROM chosen",
    "balance_propagate": f"WITH {PROBES}, {_sampled('''SELECT DISTINCT 'all' AS draw, label, 100 AS n FROM probes''')} SELECT c.label, source, count(*) AS n FROM chosen c JOIN probes USING (row_id) GROUP BY ALL",
    "balanced_pairs": PAIRS,
    "rotated_split": """SELECT source, position::INTEGER AS position, CASE WHEN (position - 6 + n) % n < 6 THEN 'test' WHEN (position - 6 + n) % n < 12 THEN 'val' ELSE 'train' END AS role
FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))""",
    "share_split": """SELECT source, CASE WHEN position < round_even(n * 0.35, 0) THEN 'test' WHEN position < 2 * round_even(n * 0.35, 0) THEN 'val' ELSE 'train' END AS role
FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))""",
    "label_combinations": f"WITH {PROBES}, {COMBS} SELECT length::INTEGER AS length, array_to_string(members, ',') AS combination FROM combs",
    "sampled_combinations": f"""WITH {PROBES}, labels AS (SELECT DISTINCT label FROM probes),
ranked AS (SELECT m, turn, label, row_number() OVER (PARTITION BY m, turn ORDER BY md5('42:' || m || ':' || turn || ':' || label)) AS r
  FROM labels, (SELECT unnest(range(2, 1 + (SELECT count(*) FROM labels))) AS m) s, range(0, 200) t(turn)),
made AS (SELECT m, turn, string_agg(label, ',' ORDER BY label) AS c FROM ranked WHERE r <= m GROUP BY m, turn),
firsts AS (SELECT m, c, row_number() OVER (PARTITION BY m ORDER BY min(turn)) AS k FROM made GROUP BY m, c)
SELECT m::INTEGER AS length, c AS combination FROM firsts WHERE k <= 3""",
    "default_label": "SELECT event_id AS row_id, CASE WHEN event_id % 3 = 0 OR event_type IS NULL THEN event_id::VARCHAR ELSE event_type END AS label FROM events",
    "hamming_pairs": f"WITH {SIGNS} SELECT item1, item2, equality, d::INTEGER AS d FROM dist",
    "hamming_weighted": f"""WITH {SIGNS} SELECT item1, item2, round(coalesce(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN s1[i] <> s2[i] THEN 1.0 + (i - 1) % 4 ELSE 0.0 END)), 0)::DOUBLE / 160 * 64, 9) AS d FROM near""",
    "pf_fingerprint": f"""WITH {PROBES} SELECT row_id, array_to_string(list_transform([2, 5, 7, 11, 13, 17, 23, 39], lambda i: replace(substr(concatenated, i + 1, 1), 'U', '0')), '') AS fp FROM probes""",
    "bit_fingerprints": f"""WITH {PROBES}, {MASKS}, {FIRST_SUMS},
chosen AS (SELECT unnest([0, 3, 6, 9, 12, 15, 18]) AS filter_id, unnest([1, 1, 2, 1, 1, 2, 1]) AS t)
SELECT row_id, string_agg(CASE WHEN score > t THEN '1' ELSE '-1' END, ',' ORDER BY filter_id) AS fp FROM scored JOIN chosen USING (filter_id) GROUP BY row_id""",
    "pf_pair_distance": f"""WITH {PROBES} SELECT a.row_id AS item1, b.row_id AS item2, len(list_filter(range(1, 41), lambda i: substr(a.concatenated, i, 1) <> substr(b.concatenated, i, 1)))::INTEGER AS d
FROM probes a JOIN probes b ON b.row_id = a.row_id + 1""",
    "roc_curve": f"WITH {CURVE} SELECT d::INTEGER AS d, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fpr, 10) AS fpr, round(tpr, 10) AS tpr FROM curve",
    "best_tau": f"""WITH {CURVE} SELECT d::DOUBLE AS best_tau, round(tpr, 10) AS tpr, round(fpr, 10) AS fpr, round(sqrt(fpr * fpr + (1 - tpr) * (1 - tpr)), 10) AS dist FROM curve
ORDER BY round(sqrt(fpr * fpr + (1 - tpr) * (1 - tpr)), 12), d LIMIT 1""",
    "auc_trapezoid": f"""WITH {CURVE} SELECT round(sum(area), 9) AS auc FROM (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS area FROM curve WINDOW w AS (ORDER BY fpr, tpr))""",
    "auc_interpolated": f"""WITH {CURVE},
top AS (SELECT fpr, max(tpr) AS tpr FROM (SELECT fpr, tpr FROM curve UNION ALL SELECT 0, 0 UNION ALL SELECT 1, 1) GROUP BY fpr),
seg AS (SELECT fpr AS x1, tpr AS y1, lead(fpr) OVER (ORDER BY fpr) AS x2, lead(tpr) OVER (ORDER BY fpr) AS y2 FROM top),
g AS (SELECT k, k / 99.0::DOUBLE AS x FROM range(0, 100) r(k)),
ys AS (SELECT k, x, (SELECT CASE WHEN x2 IS NULL THEN y1 ELSE y1 + (y2 - y1) * (x - x1) / (x2 - x1) END FROM seg WHERE x1 <= x + 1e-11 ORDER BY x1 DESC LIMIT 1) AS y FROM g)
SELECT round(sum(a), 8) AS auc FROM (SELECT (x - lag(x) OVER (ORDER BY k)) * (y + lag(y) OVER (ORDER BY k)) / 2 AS a FROM ys)""",
    "ascii_sums": f"""SELECT item_id, {_byte_sum('h')} AS s, {_byte_sum('hf')} AS odd, {_byte_sum('hj')} AS joined, {_byte_sum('hs')} AS stripped
FROM (SELECT item_id, h, h || 'f' AS hf, h || ';00' AS hj, h || '00' AS hs FROM (SELECT item_id, lower(hex(encode(text))) AS h FROM benchmark))""",
    "min_max_features": """SELECT p_partkey, round((p_size - a) / (b - a), 10) AS p_size, round((p_retailprice - c) / (e - c), 10) AS p_retailprice
FROM part, (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice)::DOUBLE AS c, max(p_retailprice)::DOUBLE AS e FROM part)""",
    "byte_sum_features": f"""WITH h AS (SELECT item_id, hex(encode(substr(text, 1, len(text) // 2))) AS x, hex(encode(substr(text, len(text) // 2 + 1))) AS y FROM benchmark),
s AS (SELECT item_id, ({_byte_sum('x')})::DOUBLE AS x, ({_byte_sum('y')})::DOUBLE AS y FROM h)
SELECT item_id AS row_id, round((x - x0) / (x1 - x0), 10) AS a, round((y - y0) / (y1 - y0), 10) AS b FROM s, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM s)""",
    "manhattan_pairs": """SELECT a.vec_id AS item1, b.vec_id AS item2, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS d
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 3""",
    "groupby_cluster": f"WITH {PROBES} SELECT row_id, (dense_rank() OVER (ORDER BY concatenated) - 1)::INTEGER AS cluster FROM probes",
    "cluster_majority": f"""WITH {PROBES}, c AS (SELECT label, dense_rank() OVER (ORDER BY concatenated) - 1 AS cluster FROM probes)
SELECT cluster::INTEGER AS cluster, label AS predicted FROM (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS r FROM (SELECT cluster, label, count(*) AS n FROM c GROUP BY 1, 2)) WHERE r = 1""",
    "dbscan_equality": f"WITH {EQUAL} SELECT row_id, cluster::INTEGER AS cluster FROM assigned",
    "dbscan_manhattan": """WITH RECURSIVE p AS (SELECT vec_id, embedding AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON list_sum(list_transform(range(1, 65), lambda i: abs(a.x[i]::DOUBLE - b.x[i]::DOUBLE))) <= 7.2),
core AS (SELECT a FROM l GROUP BY a HAVING count(*) >= 4),
e AS (SELECT l.a, l.b FROM l JOIN core c ON c.a = l.a JOIN core k ON k.a = l.b),
reach AS (SELECT a, a AS b FROM core UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
num AS (SELECT a, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root)
SELECT p.vec_id AS row_id, coalesce(n.cluster, (SELECT min(m.cluster) FROM l JOIN num m ON m.a = l.b WHERE l.a = p.vec_id), -1)::INTEGER AS cluster FROM p LEFT JOIN num n ON n.a = p.vec_id""",
    "cluster_metrics": f"""WITH {EQUAL}, one AS (SELECT 1 AS k, * FROM assigned), {_agree("one", "k")},
code AS (SELECT label, dense_rank() OVER (ORDER BY first) AS code FROM (SELECT label, min(row_id) AS first FROM assigned GROUP BY 1)),
best AS (SELECT cluster, label FROM (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS r FROM (SELECT cluster, label, count(*) AS n FROM assigned WHERE cluster >= 0 GROUP BY 1, 2)) WHERE r = 1),
err AS (SELECT sqrt(avg((c.code - g.code) * (c.code - g.code))) AS rmse FROM assigned a JOIN best b USING (cluster) JOIN code c ON c.label = a.label JOIN code g ON g.label = b.label)
SELECT {", ".join(f"round({v}, 8) AS {n}" for n, v in zip(_NAMES, _VALUES))}, round((SELECT avg((cluster = -1)::INTEGER) FROM assigned), 8) AS noise_ratio,
round((SELECT rmse FROM err), 8) AS rmse, (SELECT count(DISTINCT cluster) FROM assigned WHERE cluster >= 0) AS n_clusters FROM agree""",
    "cluster_metrics_advanced": f"""WITH {EQUAL}, one AS (SELECT 1 AS k, * FROM assigned), clustered AS (SELECT * FROM one WHERE cluster >= 0), {_agree("one", "k", "x")}, {_agree("clustered", "k", "y")},
acc AS (SELECT sum(best) / sum(n) AS label_accuracy FROM (SELECT cluster, max(n) AS best, sum(n) AS n FROM (SELECT cluster, label, count(*) AS n FROM clustered GROUP BY ALL) GROUP BY 1))
SELECT {", ".join(f"round({t}.{v}, 8) AS {n}_{s}" for t, s in (("x", "all"), ("y", "clustered")) for n, v in zip(_NAMES, _VALUES))},
round((SELECT avg((cluster = -1)::INTEGER) FROM assigned), 8) AS noise_ratio, round(1 - (SELECT avg((cluster = -1)::INTEGER) FROM assigned), 8) AS coverage,
round((SELECT label_accuracy FROM acc), 8) AS label_accuracy, (SELECT count(DISTINCT cluster) FROM clustered) AS n_clusters FROM x JOIN y USING (k)""",
    "dbscan_grid": f"WITH {GRID} SELECT length::INTEGER AS length, eps::DOUBLE AS eps, min_samples, n_combinations, round(v_measure, 8) AS v_measure FROM grid",
    "dbscan_grid_best": f"""WITH {GRID} SELECT eps::DOUBLE AS eps, min_samples, count(DISTINCT length) AS n_lengths, sum(n_combinations)::BIGINT AS n_combinations, round(avg(v_measure), 8) AS v_measure
FROM grid GROUP BY eps, min_samples ORDER BY round(avg(v_measure), 12) DESC, eps, min_samples LIMIT 1""",
    "groupby_on_combinations": f"""WITH {PROBES}, {COMBS}, put AS (SELECT comb, length, label, concatenated AS cluster FROM combs JOIN probes ON list_contains(members, label)), {_agree("put", "comb, length")}
SELECT length::INTEGER AS length, round(v, 8) AS v_measure, round(ari, 8) AS ari, 0.0::DOUBLE AS noise_ratio, (SELECT count(DISTINCT cluster) FROM put WHERE put.comb = agree.comb) AS n_clusters FROM agree""",
    "one_shot_comparison": f"""WITH {EQUAL}, g AS (SELECT 'group' AS clustering, label, concatenated AS cluster FROM probes UNION ALL SELECT 'dbscan', label, concatenated FROM assigned WHERE cluster >= 0), {_agree("g", "clustering")}
SELECT clustering, (SELECT count(DISTINCT cluster) FROM g WHERE g.clustering = agree.clustering) AS n_clusters, round(nn / (SELECT count(*) FROM probes), 8) AS coverage, round(v, 8) AS v_measure_clustered FROM agree""",
    "metric_by_length": """SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity::DOUBLE), 6) AS mean, round(stddev_samp(l_quantity::DOUBLE), 6) AS deviation,
round(quantile_cont(l_quantity::DOUBLE, 0.25), 6) AS q1, round(quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS median, round(quantile_cont(l_quantity::DOUBLE, 0.75), 6) AS q3 FROM lineitem GROUP BY ALL""",
    "boost_round1": f"""WITH {PROBES}, {MASKS}, {FIRST_SUMS},
pairs AS (SELECT a.row_id AS item1, b.row_id AS item2, CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS y FROM probes a JOIN probes b ON b.row_id BETWEEN a.row_id + 1 AND a.row_id + 3),
t AS (SELECT s.filter_id, s.block AS width, y, s.score AS sa, z.score AS sb, unnest(range(1, s.block + 1)) AS threshold FROM pairs JOIN scored s ON s.row_id = item1 JOIN scored z ON z.row_id = item2 AND z.filter_id = s.filter_id)
SELECT filter_id::INTEGER AS filter_id, threshold::INTEGER AS threshold, width::INTEGER AS width,
round(avg((CASE WHEN (sa > threshold) = (sb > threshold) THEN 1 ELSE -1 END <> y)::INTEGER), 10) AS err FROM t GROUP BY filter_id, threshold, width""",
    "combination_members": f"WITH {PROBES}, {COMBS} SELECT length::INTEGER AS length, count(*) AS n FROM combs JOIN probes ON list_contains(members, label) GROUP BY 1",
    "ext_cap_bits": f"SELECT item_id, {_bits('h')} AS bits FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark)",
    "ext_cap_fields": f"SELECT item_id, {_ext_fields()} FROM (SELECT item_id, {_bits('h')} AS bits FROM (SELECT item_id, hex(encode(substr(text, 1, 9))) AS h FROM benchmark))",
    "ht_cap_fields": f"SELECT item_id, {_ht_fields()} FROM (SELECT item_id, {_ht_bits('h')} AS bits FROM (SELECT item_id, hex(encode(substr(text, 1, 26))) AS h FROM benchmark))",
    "boost_model": f"{_boosted()} SELECT round, filter_id, Bitmask AS filter, threshold, width, round(min_error, 8) AS min_error, round(confidence, 6) AS confidence FROM model",
    "model_text": f"""{_boosted()} SELECT '0[' || start || '] ' || translate(substr(Bitmask, start + 1, block), '1N', 'xo') || ' 0[' || (40 - start - block) || ']' AS best_filter_fancy, Bitmask AS best_filter,
threshold AS best_threshold, CASE WHEN min_error < 1e-10 THEN '0' ELSE printf('%.2e', min_error) END AS min_error, CASE WHEN confidence > 40 THEN 'inf' ELSE printf('%.2f', confidence) END AS confidence FROM model""",
    "sums_grid": f"""WITH RECURSIVE {_dense("SELECT * FROM combs WHERE length IN (SELECT length FROM (SELECT length, row_number() OVER (ORDER BY length) AS t FROM (SELECT DISTINCT length FROM combs)) WHERE t % 2 = 1)", "[1e-5, 1e-2]", "[2, 6]")}
SELECT length::INTEGER AS length, eps::DOUBLE AS eps, least AS min_samples, count(*) AS n_combinations, round(avg(v), 8) AS v_measure FROM agree GROUP BY ALL""",
    "sums_on_combinations": f"""WITH RECURSIVE {_dense("SELECT * FROM combs", "[1e-2]", "[2]")}
SELECT length::INTEGER AS length, round(v, 8) AS v_measure, round(ari, 8) AS ari, round((SELECT avg((cluster = -1)::INTEGER) FROM put WHERE put.comb = agree.comb), 8) AS noise_ratio,
(SELECT count(DISTINCT cluster) FROM put WHERE put.comb = agree.comb AND cluster <> -1) AS n_clusters FROM agree""",
    "capture_hex": f"""WITH {CAPTURED} SELECT packet, (1000 + i) || '.' || lpad((i % 1000000)::VARCHAR, 6, '0') AS "Timestamp", mac AS "MAC Address", (i % 13 + 1)::VARCHAR AS "Channel", (i % 11 + 1)::VARCHAR AS "DS Channel",
substr(sha, 1, 52) AS "HT Capabilities", substr(sha, 47, 18) AS "Extended Capabilities", sha || ';' || md AS "Vendor Specific Tags", md AS "SSID", '02040b16' AS "Supported Rates", '' AS "Extended Supported Rates",
'' AS "VHT Capabilities", substr(md, 1, 12) AS "HE Capabilities", '183' AS "Length", name AS "Label" FROM captured""",
    "capture_binary": f"WITH {CAPTURED} SELECT packet, {_binary_columns()}, name AS label FROM captured",
    "capture_dissected": f"""WITH {CAPTURED}, shaped AS (SELECT *, {_ht_bits("upper(substr(sha, 1, 52))")} AS ht, {_bits("upper(substr(sha, 47, 18))")} AS ext FROM captured)
SELECT packet, 1000 + i + (i % 1000000) / 1e6::DOUBLE AS "Timestamp", mac AS "MAC Address", (i % 13 + 1)::INTEGER AS "Channel", (i % 11 + 1)::INTEGER AS "DS Channel", (16 * i % 65536) / 16.0::DOUBLE AS "SN",
sha AS "Vendor Specific Tags", md AS "SSID", NULL::VARCHAR AS "VHT Capabilities", '23' || substr(md, 1, 12) AS "HE Capabilities", 183 AS "Length", name AS "Label",
1.0::DOUBLE AS "Supported Rates 1", 2.0::DOUBLE AS "Supported Rates 2", 5.5::DOUBLE AS "Supported Rates 3", 11.0::DOUBLE AS "Supported Rates 4", {", ".join(f'NULL::DOUBLE AS "Supported Rates {k}"' for k in range(5, 9))},
{", ".join(f'NULL::DOUBLE AS "Extended Supported Rates {k}"' for k in range(1, 9))}, {_ht_fields("ht")}, {_ext_fields("ext")} FROM shaped""",
    "roc_real": """WITH near AS (SELECT list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS x, CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS equality
  FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 7),
bins AS (SELECT round(x, 6) AS d, count(*) FILTER (equality = 1) AS p, count(*) FILTER (equality <> 1) AS q FROM near GROUP BY 1),
cum AS (SELECT d, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq, lag(d) OVER w AS before, lead(d) OVER w AS after, lead(p) OVER w AS p2, lead(q) OVER w AS q2 FROM bins WINDOW w AS (ORDER BY d))
SELECT d, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fp / nq, 10) AS fpr, round(tp / np, 10) AS tpr FROM cum WHERE before IS NULL OR after IS NULL OR p <> p2 OR q <> q2""",
    "roc_one_class": f"WITH {SIGNS} SELECT count(*) AS pairs, 0::BIGINT AS points FROM dist WHERE equality = 1",
    "sums_pair_distance": f"""WITH raw AS (SELECT p_partkey AS i, ({_byte_sum("hex(encode(p_name))")})::DOUBLE AS x, ({_byte_sum("hex(encode(p_brand))")})::DOUBLE AS y FROM part),
met AS (SELECT a.i AS item1, b.i AS item2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM raw a JOIN raw b ON b.i BETWEEN a.i + 1 AND a.i + 3),
e AS (SELECT min(x1) AS a1, max(x1) AS b1, min(y1) AS c1, max(y1) AS d1, min(x2) AS a2, max(x2) AS b2, min(y2) AS c2, max(y2) AS d2 FROM met)
SELECT item1, item2, round(abs((x1 - a1) / (b1 - a1) - (x2 - a2) / (b2 - a2)) + abs((y1 - c1) / (d1 - c1) - (y2 - c2) / (d2 - c2)), 9) AS apart,
round(abs(x1 - x2) / (greatest(b1, b2) - least(a1, a2)) + abs(y1 - y2) / (greatest(d1, d2) - least(c1, c2)), 9) AS together FROM met, e""",
    "role_rows": """SELECT role, count(*) AS n FROM documents JOIN (SELECT source, CASE WHEN (position - 6 + n) % n < 6 THEN 'test' WHEN (position - 6 + n) % n < 12 THEN 'val' ELSE 'train' END AS role
FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))) USING (source) GROUP BY role""",
    "positions_view": f"""WITH {SUITABLE}, o AS (SELECT pos, u, row_number() OVER (ORDER BY u DESC, pos) AS r FROM suit),
t AS (SELECT greatest(0.0, 1 - 0.001 * ceil(round((1 - u) / 0.001, 9))) AS threshold FROM o WHERE r = 8) SELECT pos::INTEGER AS "Index" FROM o, t WHERE u >= threshold""",
    "auc_by_method": f"""WITH {CURVE} SELECT 'signs' AS method, (SELECT round(sum(area), 8) FROM (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS area FROM curve WINDOW w AS (ORDER BY fpr, tpr))) AS auc""",
    "unique_items": "SELECT DISTINCT item FROM (SELECT vec_id AS item FROM embeddings WHERE vec_id + 3 IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id FROM embeddings WHERE vec_id - 3 IN (SELECT vec_id FROM embeddings))",
    "fingerprint_halves": f"""WITH {PROBES}, f AS (SELECT row_id, replace(concatenated, 'U', '0') AS fp FROM probes)
SELECT row_id, (SELECT sum(CASE WHEN substr(fp, i, 1) = '1' THEN 1 << (20 - i) ELSE 0 END) FROM range(1, 21) r(i))::DOUBLE AS x, (SELECT sum(CASE WHEN substr(fp, 20 + i, 1) = '1' THEN 1 << (20 - i) ELSE 0 END) FROM range(1, 21) r(i))::DOUBLE AS y FROM f""",
    "read_model": f"""{_boosted()} SELECT Bitmask AS best_filter, threshold, CASE WHEN confidence > 40 THEN 1e6 ELSE printf('%.2f', confidence)::DOUBLE END AS confidence FROM model""",
    "concatenated_probes": f"""WITH {CAPTURED} SELECT name AS label, packet, lpad({_high_first("lpad(to_hex(i % 11 + 1), 2, '0')")}, 8, '0') || '00011010' || {_high_first("substr(sha, 1, 52)")} || '00001001' || {_high_first("substr(sha, 47, 18)")}
|| '00010000' || rpad({_high_first("(sha || 'dd10' || md)")}, 1336, 'U') AS concatenated FROM captured""",
    "channels": """SELECT f::INTEGER AS freq, CASE WHEN f BETWEEN 2412 AND 2472 AND (f - 2412) % 5 = 0 THEN (1 + (f - 2412) // 5)::VARCHAR WHEN f = 2484 THEN '14' ELSE f::VARCHAR END AS channel,
trunc((f - 2407) / 5)::INTEGER AS number FROM range(2400, 5200) r(f)""",
    "capture_types": "SELECT * FROM (VALUES (1, 'pcap'), (2, 'pcap'), (3, 'pcapng'), (4, NULL), (5, NULL)) v(id, type)",
}
