"""DuckDB SQL for the results of queries whose rules SQL can state by brute force, whatever the method behind the query."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def substring_sql(length: int = 35) -> str:
    """All windows of all rows, counted; words under repeated ones removed."""
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, {WORDS} AS ws FROM documents),
starts AS MATERIALIZED (SELECT rid, s, md5(array_to_string(list_slice(ws, s, s + {length - 1}), ' ')) AS h FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - {length - 1})) AS s FROM w WHERE len(ws) >= {length})),
again AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT rid, s + k AS i FROM (SELECT rid, s FROM starts WHERE h IN (SELECT h FROM again)) CROSS JOIN (SELECT unnest(generate_series(0, {length - 1})) AS k)),
spelled AS (SELECT rid, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
kept AS (SELECT s.rid, count(*) AS n, string_agg(word, ' ' ORDER BY s.i) AS text FROM spelled s LEFT JOIN covered c ON s.rid = c.rid AND s.i = c.i WHERE c.rid IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.rid = kept.rid"""


def jaccard_sql(shingle: int = 5, threshold: float = 0.8) -> str:
    """All pairs of texts that share a shingle, by exact Jaccard similarity, and the classes they connect."""
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, ws, md5(array_to_string(ws, ' ')) AS t FROM (SELECT doc_id, {WORDS} AS ws FROM documents)),
texts AS MATERIALIZED (SELECT t, any_value(ws) AS ws, min(doc_id) AS rep, count(*) AS n_copies FROM w WHERE len(ws) > 0 GROUP BY t),
shingles AS MATERIALIZED (SELECT DISTINCT t, md5(array_to_string(list_slice(ws, s, s + {shingle - 1}), ' ')) AS h FROM (SELECT t, ws, unnest(generate_series(1, greatest(1, len(ws) - {shingle - 1}))) AS s FROM texts)),
sizes AS MATERIALIZED (SELECT t, count(*) AS n FROM shingles GROUP BY t),
common AS MATERIALIZED (SELECT a.t AS t, b.t AS u, count(*) AS n FROM shingles a JOIN shingles b ON a.h = b.h AND a.t <> b.t GROUP BY 1, 2),
links AS MATERIALIZED (SELECT c.t, c.u FROM common c JOIN sizes a ON c.t = a.t JOIN sizes b ON c.u = b.t WHERE c.n >= {threshold}::DOUBLE * (a.n + b.n - c.n)),
reach AS (SELECT t, t AS u FROM texts UNION SELECT reach.t, links.u FROM reach JOIN links ON reach.u = links.t),
classes AS MATERIALIZED (SELECT reach.t, min(rep) AS class_id FROM reach JOIN texts ON reach.u = texts.t GROUP BY 1),
degree AS MATERIALIZED (SELECT t, count(*) AS n FROM links GROUP BY t)
SELECT doc_id, CASE WHEN len(w.ws) > 0 THEN class_id ELSE doc_id END AS class_id, coalesce(degree.n, 0) AS n_links, coalesce(texts.n_copies, 1) AS n_copies
FROM w LEFT JOIN texts ON w.t = texts.t AND len(w.ws) > 0 LEFT JOIN classes ON w.t = classes.t LEFT JOIN degree ON w.t = degree.t"""


def sharding_sql(n_shards: int = 16, seed: int = 2024) -> str:
    """crc32 byte by byte, row numbers by id, and the Feistel network round by round; for tables of unique ids."""
    from rollmill.llm.sharding import ROUNDS, Feistel

    keys = ", ".join(f"{int(k)}::UBIGINT" for k in Feistel(1, seed).keys)
    times = lambda x, c: f"((({x})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""WITH RECURSIVE bits AS (SELECT unnest(generate_series(0, 255)) AS b),
steps AS (SELECT b, b::UBIGINT AS v, 0 AS k FROM bits UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
hexed AS MATERIALIZED (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS MATERIALIZED (SELECT doc_id, size + 1 AS size, xor(list_reduce(list_transform(range(size), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UTINYINT::UBIGINT), lambda a, x: xor(a >> 8, crc.t[CAST(xor(a & 255::UBIGINT, x) AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS text_crc32 FROM hexed, crc),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_number FROM summed),
total AS MATERIALIZED (SELECT count(*) AS n, greatest(1, (len(bin(greatest(count(*), 2) - 1)) + 1) // 2)::UBIGINT AS half FROM documents),
walk AS (SELECT row_number, (row_number::UBIGINT >> half) AS l, (row_number::UBIGINT & ((1::UBIGINT << half) - 1)) AS r, 0 AS k FROM numbered, total
  UNION ALL
  SELECT row_number, CASE WHEN k = {ROUNDS} THEN l ELSE r END, CASE WHEN k = {ROUNDS} THEN r ELSE xor(l, x5 & ((1::UBIGINT << half) - 1)) END, CASE WHEN k = {ROUNDS} THEN 0 ELSE k + 1 END FROM (
    SELECT *, xor(x4, x4 >> 31) AS x5 FROM (SELECT *, {times("x3", 0x94D049BB133111EB)} AS x4 FROM (SELECT *, xor(x2, x2 >> 27) AS x3 FROM (
      SELECT *, {times("x1", 0xBF58476D1CE4E5B9)} AS x2 FROM (SELECT *, xor(x0, x0 >> 30) AS x1 FROM (SELECT walk.*, n, half, xor(r, [{keys}][least(k, {ROUNDS - 1}) + 1]) AS x0 FROM walk, total)))))) AS mixed
  WHERE NOT (k = {ROUNDS} AND ((l << half) | r) < n)),
placed AS (SELECT row_number, ((l << half) | r)::BIGINT AS place FROM walk, total WHERE k = {ROUNDS} AND ((l << half) | r) < n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place % {n_shards} AS INTEGER) AS shard, place // {n_shards} AS slot, NULL::INTEGER AS grown_shard, row_number FROM numbered JOIN placed USING (row_number)"""


def mixing_sql(seed: int = 7) -> str:
    """Tokens by source, the exponent by bisection over the list of them, and each unit's place in the order of its source's last pass."""
    from rollmill.llm import mixing as m

    key = f"('0x' || substr(md5('{seed}|' || coalesce('1' || doc_id, '0') || '|' || coalesce('1' || text, '0')), 1, {m.KEY_BITS // 4}))::BIGINT"
    weights = "list_transform(ns, lambda x: pow(x / most, {a}))"
    entropy = f"(ln(list_sum({weights})) - {{a}} * list_sum(list_transform(ns, lambda x: pow(x / most, {{a}}) * ln(x / most))) / list_sum({weights}))"
    repetition = f"(list_max(list_transform(ns, lambda x: pow(x / most, {{a}}) / x)) / list_sum({weights}) * budget)"

    def bisect(name: str, start: str, end: str, good: str) -> str:
        """From start towards end: the exponent from which ``good`` holds; null where it does not hold at the end."""
        middle = good.format(a="((lo + hi) / 2)")
        return f"""{name}_steps AS (SELECT 0 AS k, {start}::DOUBLE AS lo, {end}::DOUBLE AS hi, * FROM {name}_of UNION ALL
  SELECT k + 1, CASE WHEN {middle} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN {middle} THEN (lo + hi) / 2 ELSE hi END, * EXCLUDE (k, lo, hi) FROM {name}_steps WHERE k < {m.STEPS}),
{name} AS MATERIALIZED (SELECT * EXCLUDE (k, lo, hi), coalesce(CASE WHEN {good.format(a=f"({start}::DOUBLE)")} THEN {start}::DOUBLE WHEN {good.format(a=f"({end}::DOUBLE)")} THEN hi END, 1) AS alpha_{name} FROM {name}_steps WHERE k = {m.STEPS})"""

    rounds = "numbered"
    for k in range(m.ROUNDS):
        mixed = f"(('0x' || substr(md5('{seed}|' || passes || '|' || name || '|{k}|' || r), 1, 8))::BIGINT & {(1 << m.HALF) - 1})"
        rounds = f"(SELECT * EXCLUDE (l, r), r AS l, xor(l, {mixed}) AS r FROM {rounds})"
    met = f"abs(entropy / ln(n) - {m.ENTROPY_SHARE}) <= {m.NEAR} AND repetition <= {m.MAX_REPETITION} * (1 + {m.NEAR})"
    return f"""WITH RECURSIVE units AS MATERIALIZED (SELECT doc_id, source, coalesce(source, '') AS name, source IS NULL AS none, CAST(len({WORDS}) AS BIGINT) AS n_tokens, {key} AS key FROM documents),
sources AS MATERIALIZED (SELECT name, none, CAST(sum(n_tokens) AS BIGINT) AS t FROM units GROUP BY ALL),
entropic_of AS (SELECT list(t::DOUBLE ORDER BY t) AS ns, max(t)::DOUBLE AS most, floor(sum(t) * {m.BUDGET_SHARE})::DOUBLE AS budget, count(*) AS n FROM sources WHERE t > 0),
{bisect("entropic", "0", str(m.TOP_EXPONENT), f"({entropy} <= {m.ENTROPY_SHARE} * ln(n))")},
limited_of AS (SELECT * FROM entropic),
{bisect("limited", "alpha_entropic", "1", f"({repetition} <= {m.MAX_REPETITION})")},
chosen AS MATERIALIZED (SELECT *, round(alpha_limited, {m.EXPONENT_DIGITS}) AS alpha FROM limited),
reached AS MATERIALIZED (SELECT *, {entropy.format(a="alpha")} AS entropy, {repetition.format(a="alpha")} AS repetition, list_sum({weights.format(a="alpha")}) AS z FROM chosen),
weighed AS MATERIALIZED (SELECT name, none, t, alpha, entropy / ln(n) AS entropy_share, repetition, {met} AS on_target, budget, CASE WHEN t > 0 THEN round(pow(t / most, alpha) / z, {m.WEIGHT_DIGITS}) ELSE 0 END AS weight FROM sources, reached),
quotas AS MATERIALIZED (SELECT *, greatest(0, floor(weight * budget - passes * t + 1e-6))::BIGINT AS left_over FROM (SELECT *, CASE WHEN t > 0 THEN floor(weight * budget / t + 1e-9) ELSE 1 END::BIGINT AS passes FROM weighed)),
numbered AS (SELECT u.*, q.* EXCLUDE (name, none), (key >> {m.KEY_BITS - m.HALF}) AS l, ((key >> {m.KEY_BITS - m.BLOCK_BITS}) & {(1 << m.HALF) - 1}) AS r FROM units u JOIN quotas q ON u.name = q.name AND u.none = q.none),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY name, none ORDER BY (l << {m.HALF}) | r, (key >> {m.KEY_BITS - 2 * m.BLOCK_BITS}) & {m.BLOCKS - 1}, key RANGE UNBOUNDED PRECEDING) AS upto FROM {rounds})
SELECT doc_id, source, n_tokens, weight, alpha, entropy_share, repetition, on_target, passes, passes + (left_over > 0 AND upto <= left_over)::BIGINT AS copies FROM placed"""


def trie_sql() -> str:
    """Every prefix of every rebuilt conversation, grouped; sums of subtrees by joining each node with the prefixes of its least member."""
    from rollmill.llm.prefixtrie import BLOCK, DIGEST, HEADS

    return f"""WITH RECURSIVE bits AS (SELECT unnest(generate_series(0, 255)) AS b),
steps AS (SELECT b, b::UBIGINT AS v, 0 AS k FROM bits UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
turns AS MATERIALIZED (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM (
  SELECT conv_id, turn, substr(sha256(strlen(r) || ':' || r || t), 1, {2 * DIGEST}) AS digest, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL))),
ids AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {BLOCK} AS block, CAST(xor(list_reduce(list_transform(range(length(s)), lambda i: ascii(substr(s, CAST(i AS INTEGER) + 1, 1))::UBIGINT), lambda a, x: xor(a >> 8, crc.t[CAST(xor(a & 255::UBIGINT, x) AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % {HEADS} AS BIGINT) AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM turns), crc),
rebuilt AS (SELECT i.conv_id, place, digest, words FROM ids i JOIN turns t ON t.conv_id = i.block AND place <= h UNION ALL SELECT i.conv_id, place, digest, words FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND place > h),
paths AS MATERIALIZED (SELECT ids.conv_id, coalesce(ds, []) AS ds, coalesce(ws, []) AS ws FROM ids LEFT JOIN (SELECT conv_id, list(digest ORDER BY place) AS ds, list(words ORDER BY place) AS ws FROM rebuilt GROUP BY 1) r ON ids.conv_id = r.conv_id),
seen AS MATERIALIZED (SELECT conv_id, d, md5(array_to_string(list_slice(ds, 1, d), '')) AS node, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(ds) AS ended FROM (SELECT *, unnest(generate_series(0, len(ds))) AS d FROM paths)),
nodes AS MATERIALIZED (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM seen GROUP BY ALL),
parents AS MATERIALIZED (SELECT n.node, n.d, p.node AS parent FROM nodes n JOIN seen p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS MATERIALIZED (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM parents GROUP BY ALL),
sums AS (SELECT a.node, a.d, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved FROM nodes n JOIN seen a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN kids ON kids.node = n.node AND kids.d = n.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON sums.node = n.node AND sums.d = n.d LEFT JOIN kids ON kids.node = n.node AND kids.d = n.d LEFT JOIN parents p ON p.node = n.node AND p.d = n.d LEFT JOIN nodes up ON up.node = p.parent AND up.d = n.d - 1"""


def bytes_sql(length: int = 400) -> str:
    """All windows of bytes of all rows, in hexadecimal digits, counted; bytes under repeated ones cut out."""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS MATERIALIZED (SELECT rid, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), {2 * length})) AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - {length - 1})) AS i FROM d WHERE length(h) >= {2 * length})),
hits AS MATERIALIZED (SELECT rid, i FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)),
runs AS MATERIALIZED (SELECT rid, min(i) AS a, max(i) + {length} AS b FROM (SELECT rid, i, sum(CASE WHEN i <= before + {length} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM hits)) GROUP BY rid, run),
cuts AS MATERIALIZED (SELECT rid, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(len(starts) + 1), lambda j: substr(h, CAST(2 * CASE WHEN j = 0 THEN 0 ELSE ends[CAST(j AS INTEGER)] END + 1 AS BIGINT), CAST(2 * (CASE WHEN j = len(starts) THEN length(h) // 2 ELSE starts[CAST(j AS INTEGER) + 1] END - CASE WHEN j = 0 THEN 0 ELSE ends[CAST(j AS INTEGER)] END) AS BIGINT))), '') END)) AS kept_sha256 FROM d LEFT JOIN cuts USING (rid)"""
