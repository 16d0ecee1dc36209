"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op5_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 3 AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight
  FROM src),
lv AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / ((sum(weight) OVER ())::DOUBLE
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS level
  FROM w),
water AS (SELECT min(level) FILTER (level <= cap / weight) AS any_level, arg_min(level, cap / weight) FILTER (level <= cap / weight) AS level FROM lv),
t AS (
  SELECT source, source_size, CASE WHEN water.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, water.level * weight) END AS target
  FROM w, water),
t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
keys AS (SELECT source, key, sum(size) AS ksize FROM sized GROUP BY source, key),
run AS (
  SELECT k.source, k.key, k.ksize, coalesce(sum(k.ksize) OVER (PARTITION BY k.source ORDER BY k.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
  FROM keys k)
SELECT s.doc_id, s.size, t2.source_size, t2.target,
       (s.size * (t2.whole + CASE WHEN t2.whole < 3 AND run.at + run.ksize / 2 <= t2.target - t2.whole * t2.source_size AND run.ksize > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s
JOIN t2 ON s.source IS NOT DISTINCT FROM t2.source
JOIN run ON s.source IS NOT DISTINCT FROM run.source AND s.key = run.key
"""

ORACLES["op1_url_filters"] = r"""
WITH cap AS (
  SELECT page_id, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched,
         nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[\]]+)', 1), '.'), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host FROM cap WHERE host IS NOT NULL),
pat AS (
  SELECT host AS pattern FROM hosts
  UNION SELECT regexp_extract(host, '^[^.\[]+\.(.+\..+)$', 1) FROM hosts WHERE regexp_extract(host, '^[^.\[]+\.(.+\..+)$', 1) <> ''),
ph AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INTEGER AS h FROM pat),
log AS (
  SELECT pattern, 'add' AS action, DATE '2024-01-01' + (h % 200) AS day FROM ph WHERE h % 3 <> 0
  UNION ALL SELECT pattern, CASE WHEN h % 2 = 0 THEN 'remove' ELSE 'add' END, DATE '2024-01-01' + (h % 200 + 60) FROM ph WHERE h % 3 <> 0
  UNION ALL SELECT pattern, CASE WHEN h % 5 = 0 THEN 'add' ELSE 'remove' END, DATE '2024-01-01' + (h % 200 + 110) FROM ph WHERE h % 3 <> 0),
state AS (
  SELECT c.page_id, l.pattern, arg_max(l.action, l.day) AS action
  FROM cap c JOIN log l ON l.day <= c.fetched AND (c.host = l.pattern OR ends_with(c.host, '.' || l.pattern))
  GROUP BY c.page_id, l.pattern),
best AS (SELECT page_id, arg_max(pattern, length(pattern)) AS entry FROM state WHERE action = 'add' GROUP BY page_id),
since AS (
  SELECT b.page_id, b.entry, min(l.day) AS active_from
  FROM best b JOIN cap c USING (page_id) JOIN log l ON l.pattern = b.entry AND l.day <= c.fetched AND l.action = 'add'
  WHERE NOT EXISTS (SELECT 1 FROM log r WHERE r.pattern = b.entry AND r.action = 'remove' AND r.day > l.day AND r.day <= c.fetched)
  GROUP BY b.page_id, b.entry)
SELECT c.page_id, c.host, c.fetched, s.entry, s.active_from, s.entry IS NOT NULL AS blocked
FROM cap c LEFT JOIN since s USING (page_id)
"""


def _seed_rows(table: str, key: str) -> str:
    """Seeds of all masks as joined words, for items of the window's length and more."""
    from millrace.llm.decontamination import MASKS

    def one(k: int, mask: str) -> str:
        words = ", ".join(f"w[i + {p + 1}]" for p, c in enumerate(mask) if c == "1")
        return f"SELECT {key}, {k} AS k, i, concat_ws(' ', {words}) AS seed FROM (SELECT {key}, w, unnest(range(0, len(w) - {len(mask) - 1})) AS i FROM {table})"

    return " UNION ALL ".join(one(k, m) for k, m in enumerate(MASKS))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
#: No item of the test tables is shorter than the window of 12 words, so the seeds of short items are not written out.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT min(item_id) AS item_id, count(*) AS n_items, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0 GROUP BY w),
hits AS (SELECT x.doc_id, y.item_id, x.i - y.i AS start, count(*) AS seeds FROM ({_seed_rows("d", "doc_id")}) x JOIN ({_seed_rows("b", "item_id")}) y ON x.k = y.k AND x.seed = y.seed GROUP BY ALL),
e AS (SELECT h.doc_id, h.item_id, h.seeds, b.n_items, list_transform(range(greatest(0, -h.start), least(len(b.w), len(d.w) - h.start)), lambda j: (d.w[h.start + j + 1] = b.w[j + 1])::INTEGER) AS e
  FROM hits h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
m AS (SELECT doc_id, item_id, seeds, n_items, list_max(list_transform(range(0, len(e) - 11), lambda s: list_sum(e[s + 1 : s + 12]))) AS matched FROM e WHERE len(e) >= 12)
SELECT doc_id, item_id, any_value(n_items) AS n_items, max(matched)::BIGINT AS matched, 12::BIGINT AS compared, sum(seeds)::BIGINT AS n_seeds FROM m WHERE matched >= 9.6 GROUP BY doc_id, item_id"""


#: CRC-32: the table by its rule, and the checksum of a text's bytes.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i))"


def _crc32(text: str) -> str:
    """Needs ``tab`` of crc_table in scope."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLES["op11_importance"] = rf"""
WITH {_CRC_TABLE},
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS word FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS word FROM benchmark),
h AS (SELECT word, ({_crc32("word")} % 10000)::INTEGER AS bucket FROM (SELECT word FROM w UNION SELECT word FROM b), crc_table),
s AS (SELECT bucket, count(*) AS s FROM w JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (word) GROUP BY bucket),
g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
         / ((s.s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
d AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM w JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
f AS (
  SELECT doc_id, coalesce(d.n, 0) AS n_features,
         CASE WHEN d.n IS NULL THEN 0 ELSE (d.total - ((d.total % d.n) + d.n) % d.n) // d.n END::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN d USING (doc_id)),
sc AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, sc.n_features, sc.weight, sc.score, CASE WHEN r.rank <= r.n * 10 // 100 THEN r.rank END AS rank
FROM sc LEFT JOIN r USING (doc_id)
"""


def _curve_steps(bits: int) -> str:
    """The turns of a three-dimensional Hilbert curve as one common table for each level and dimension, from c0(x0, x1, x2)."""
    out, k = [], 0
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for d in range(3):
            flip = f"(x{d} >> {level}) & 1 = 1"
            swap = f"CASE WHEN {flip} THEN 0 ELSE xor(x0, x{d}) & {below} END"
            new = [f"CASE WHEN {flip} THEN xor(x0, {below}) ELSE xor(x0, {swap}) END AS x0"]
            new += [f"xor(x{i}, {swap}) AS x{i}" if i == d else f"x{i}" for i in (1, 2)]
            out.append(f"c{k + 1} AS (SELECT k0, k1, k2, {', '.join(new)} FROM c{k})")
            k += 1
    planes = [f"((x{d} >> {level}) & 1)" for level in range(bits - 1, -1, -1) for d in range(3)]
    index = " + ".join(f"((({' + '.join(planes[: i + 1])}) & 1) << {len(planes) - 1 - i})" for i in range(len(planes)))
    out.append(f"curve AS (SELECT k0, k1, k2, {index} AS curve FROM c{k})")
    return ",\n".join(out)


ORACLES["op12_sharding"] = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, source, lang, coalesce(strlen(text), 0)::BIGINT + 8 AS size, coalesce({_crc32("text")}, 0)::BIGINT AS text_crc32 FROM documents, crc_table),
n AS (SELECT count(*) AS n FROM documents),
cells AS (
  SELECT doc_id, size, text_crc32,
         (rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1) * 16 // n AS k0,
         (rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1) * 16 // n AS k1,
         (rank() OVER (ORDER BY size) - 1) * 16 // n AS k2
  FROM d, n),
c0 AS (SELECT DISTINCT k0, k1, k2, k0 AS x0, k1 AS x1, k2 AS x2 FROM cells),
{_curve_steps(4)},
p AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id) - 1 AS place FROM cells JOIN curve USING (k0, k1, k2)),
s AS (SELECT *, (place * 24 // n)::INTEGER AS shard FROM p, n)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""


def _code_rounds(rounds: int) -> str:
    """Assignments a1, a2, ... and the codebooks b1, b2, ... after each round, from the parts x(vec_id, j, v) and the codebooks b0(j, e, v)."""
    out = []
    for k in range(rounds + 1):
        off = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, j, arg_min(e, (off, e)) AS e, min(off) AS off FROM (SELECT x.vec_id, x.j, b.e, {off}::BIGINT AS off FROM x JOIN b{k} b USING (j)) GROUP BY vec_id, j)")
        if k < rounds:
            mean = "list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i)"
            sums = f"SELECT j, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT a.j, a.e, unnest(range(len(x.v))) AS i, unnest(x.v) AS c FROM a{k} a JOIN x USING (vec_id, j)) GROUP BY j, e, i"
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT j, e, {mean} AS v FROM ({sums}) GROUP BY j, e) m USING (j, e))")
    return ",\n".join(out)


ORACLES["op13_vector_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, j, v[j * (len(v) // 16) + 1 : (j + 1) * (len(v) // 16)] AS v FROM kept, (SELECT unnest(range(16)) AS j)),
b0 AS MATERIALIZED (SELECT j, e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 64),
{_code_rounds(2)},
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY j) AS code, sum(off)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY j, e)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op6_decontamination": DECONTAMINATION}
