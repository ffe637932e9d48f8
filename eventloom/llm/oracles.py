"""SQL (DuckDB) for the queries that it can express."""

from __future__ import annotations

from .quality_rules import RULES, WINDOW, path

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
TEXT = "coalesce(text, '')"

OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format(TEXT))} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM p), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen), m AS (SELECT doc_id, min(seen) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, d.doc_id = coalesce(m.c, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

PLAIN_WORDS = r"regexp_extract_all({0}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
OP6 = f"""WITH d AS (SELECT doc_id, {PLAIN_WORDS.format(LOWER.format(TEXT))} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN_WORDS.format(LOWER.format(TEXT))} AS w FROM benchmark),
t AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0), q AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM t),
k AS (SELECT DISTINCT n FROM q), p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n), f AS (SELECT doc_id, i, p.n, item FROM p JOIN q ON q.n = p.n AND q.s = array_to_string(w[i:i + p.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM f) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

#: ln of the number of ways to choose {1} of {0}.
CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
#: Probability of k marked ones among d of pop, of which m are marked.
CHANCE = f"exp({CHOOSE.format('m', 'k')} + {CHOOSE.format('(pop - m)', '(d - k)')} - {CHOOSE.format('pop', 'd')})"
OP9 = f"""WITH RECURSIVE s AS (SELECT doc_id, source, coalesce('=' || source, '') AS sk, CAST(len({WORDS.format(TEXT)}) AS BIGINT) AS size, CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5({TEXT})), 1, 8) AS BIGINT) AS h FROM documents),
t AS (SELECT source, sk, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM t),
c AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(rank - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM r),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c),
f AS (SELECT sk, source_size, least(cap, (SELECT arg_min(lv, (cap / w, rank)) FROM l WHERE lv <= cap / w) * w) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes, CAST(greatest(1, ceil(source_size / 65536.0)) AS BIGINT) AS blocks FROM f),
p AS (SELECT doc_id, s.sk, size, h, source_size, target, passes, blocks, (h * blocks) >> 32 AS block, CAST(round(target) AS BIGINT) - passes * source_size AS rest FROM s JOIN g ON s.sk = g.sk),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sk ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
o AS (SELECT sk, block, coalesce(sum(sum(size)) OVER (PARTITION BY sk ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, any_value(rest) AS rest FROM p GROUP BY 1, 2),
q AS (SELECT g.sk, CAST(any_value(passes) * any_value(blocks) + coalesce(max(block) FILTER (WHERE base < rest) + 1, 0) AS BIGINT) AS draws FROM g JOIN o ON o.sk = g.sk GROUP BY 1),
z AS (SELECT list(sk ORDER BY sk) AS ks, list(draws ORDER BY sk) AS ds, greatest(4, CAST(ceil(log2(greatest(1.0, (SELECT sum(source_size) FROM g) / 67108864.0))) AS INT)) AS levels FROM q),
e AS (SELECT 0 AS level, 0::BIGINT AS node, 1 AS i, ds AS q, list_sum(ds)::BIGINT AS pop, CAST(floor(list_sum(ds) / 2) AS BIGINT) AS d, []::BIGINT[] AS a FROM z WHERE len(ks) > 0
 UNION ALL SELECT level + n.up, CASE WHEN n.up = 1 THEN node * 2 + side ELSE node END, CASE WHEN n.up = 1 THEN 1 ELSE i + 1 END, kids, CASE WHEN n.up = 1 THEN list_sum(kids)::BIGINT ELSE pop - m END, CASE WHEN n.up = 1 THEN CAST(floor(list_sum(kids) / 2) AS BIGINT) ELSE d - k END, CASE WHEN n.up = 1 THEN []::BIGINT[] ELSE list_append(a, k) END FROM (
  SELECT y.*, side, CASE WHEN up = 0 THEN q WHEN side = 0 THEN list_append(a, k) ELSE [q[x] - list_append(a, k)[x] FOR x IN range(1, len(q) + 1)] END AS kids FROM (
   SELECT x.*, CASE WHEN i = len(q) THEN 1 ELSE 0 END AS up, CASE WHEN high <= low THEN low ELSE least(high, low + len(list_filter([list_sum(list_slice(chances, 1, x)) FOR x IN range(1, len(chances) + 1)], lambda v: v < u))) END AS k FROM (
    SELECT w.*, [{CHANCE} FOR k IN range(low, high + 1)] AS chances FROM (
     SELECT v.*, greatest(0, d - (pop - m), CAST(floor(d * share - spread) AS BIGINT)) AS low, least(m, d, CAST(ceil(d * share + spread) AS BIGINT)) AS high FROM (
      SELECT h.*, sqrt(d * share * (1 - share) * (pop - d) / greatest(pop - 1, 1)) * 9 + 9 AS spread FROM (
       SELECT e.*, q[i] AS m, q[i] / greatest(pop, 1)::DOUBLE AS share, (CAST('0x' || substr(md5('17|' || level || '|' || node || '|' || ks[i]), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM e, z WHERE level < levels) h) v) w) x) y, (SELECT unnest([0, 1]) AS side) WHERE up = 1 OR side = 0) n),
j AS (SELECT ks[x] AS sk, node, q[x] AS n FROM e, z, (SELECT unnest(range(1, (SELECT len(ks) FROM z) + 1)) AS x) WHERE level = levels), k AS (SELECT sk, list(ends ORDER BY node) AS ends FROM (SELECT *, sum(n) OVER (PARTITION BY sk ORDER BY node) AS ends FROM j) GROUP BY 1),
m AS (SELECT doc_id, size, source_size, target, passes, blocks, block, ends, greatest(0, least(size, rest - before)) AS part FROM b JOIN k ON k.sk = b.sk)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken, array_to_string([len(list_filter(ends, lambda v: v <= y * blocks + block)) FOR y IN range(0, passes + CASE WHEN part > 0 THEN 1 ELSE 0 END)], ',') AS shards FROM m"""


def op5(alpha: float = 0.01, delta: float = 0.05) -> str:
    """The quality rules; figures, the path of cutoffs and its tests are written out from the same table of rules."""
    figure = {
        "symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
        "upper": "n_upper / greatest(word_chars, 1)", "word_length": "word_chars / greatest(n_words, 1)",
    }
    steps = path()
    wrong = lambda step: " OR ".join(f"{figure[r]} > {c}" for r, c in step.items())
    counts = ", ".join(f"count(*) FILTER (WHERE {wrong(step)}) AS x{k}" for k, step in enumerate(steps) if step)
    tail = f"list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})) FOR i IN range(0, {{0}} + 1)])"
    failed = " ".join(f"WHEN NOT (x{k} < {alpha} * n AND {tail.format(f'x{k}')} <= {delta} / (SELECT count(*) FROM o)) THEN {k}" for k, step in enumerate(steps) if step)
    at = f"CASE {failed} ELSE {len(steps)} END"
    cuts = ", ".join(f"([{', '.join(str(step.get(r, 'NULL')) for step in steps)}])[step] AS cut_{r}" for r in RULES)
    over = " OR ".join(f"coalesce({figure[r]} > cut_{r}, false)" for r in RULES)
    return rf"""WITH w AS (SELECT doc_id, lang, {TEXT} AS text, {WORDS.format(TEXT)} AS w, list_filter(string_split({TEXT}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, w FROM w WHERE len(w) >= {WINDOW}), k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + {WINDOW - 1}]) AS c FROM p),
    v AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS x FROM k WHERE c > 1) GROUP BY 1),
    f AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN v USING (doc_id)),
    g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f), y AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
    o AS (SELECT lang, count(*) AS n, {counts} FROM g JOIN y USING (doc_id) WHERE NOT base_failed GROUP BY 1), t AS (SELECT *, {at} AS step FROM o), c AS (SELECT lang, {cuts} FROM t)
    SELECT g.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM g LEFT JOIN c ON g.lang IS NOT DISTINCT FROM c.lang"""


OP11 = f"""WITH d AS (SELECT doc_id, string_split({TEXT}, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, {LOWER.format("trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13))")} AS key FROM p),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3), m AS (SELECT k.doc_id, i, l, coalesce(k.doc_id <> top, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""

OP12 = f"""WITH d AS (SELECT doc_id, {PLAIN_WORDS.format(LOWER.format(TEXT))} AS w FROM documents), b AS (SELECT item_id, {PLAIN_WORDS.format(LOWER.format(TEXT))} AS w FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nd, sum(len(w)) AS l FROM d), a AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(w) AS t FROM b) GROUP BY ALL),
f AS (SELECT doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t), g AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT nd FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f GROUP BY t),
x AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score FROM a JOIN f USING (t) JOIN g USING (t), s GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0) SELECT * FROM r WHERE rank <= 20"""


def op13(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Lloyd's rounds written out: assignments a0, a1, ... to codebooks c0, c1, ..."""
    first = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), u AS MATERIALIZED (SELECT id, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM v, range({parts}) AS r(p)),
    c0 AS MATERIALIZED (SELECT p, id - 1 AS k, x AS c FROM u WHERE id <= {entries})"""
    step = """, a{0} AS MATERIALIZED (SELECT id, p, any_value(x) AS x, arg_min(k, (e, k)) AS k, min(e) AS e FROM (SELECT u.id, u.p, k, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS e FROM u JOIN c{0} ON c{0}.p = u.p) GROUP BY 1, 2)"""
    replace = """, s{0} AS (SELECT p, k, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM (SELECT p, k, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{0}) GROUP BY ALL),
    c{1} AS MATERIALIZED (SELECT p, k, coalesce(n, c) AS c FROM c{0} LEFT JOIN (SELECT p, k, list(y ORDER BY i) AS n FROM s{0} GROUP BY 1, 2) USING (p, k))"""
    return first + "".join(step.format(r) + replace.format(r, r + 1) for r in range(rounds)) + step.format(rounds) + f""", q AS (SELECT id, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, CAST(sum(e) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN q USING (id), h"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_dedup": OP4, "op5_quality_rules": op5(), "op6_decontamination": OP6, "op9_mixing": OP9, "op11_line_dedup": OP11, "op12_lexical_topk": OP12, "op13_vector_codes": op13()}
