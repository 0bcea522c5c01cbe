"""DuckDB SQL for the corpus queries that SQL can express, written independently of the Spark code."""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP5 = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) AS n_lines FROM lines
        WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, host, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         word_chars / greatest(n_words, 1) < 2.0 OR word_chars / greatest(n_words, 1) > 15.0
         OR n_symbols > 0.25 * n_words OR n_dup_lines > 0.5 * n_lines AS soft_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS k FROM f GROUP BY host),
mo AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
pr AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1.0 END AS s FROM mo),
hv AS (SELECT host, (k + m * s) / (n + s) AS rate FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR rate >= 0.9 OR (rate >= 0.4 AND soft_failed)) AS kept
FROM f JOIN hv USING (host)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, {ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW}, {ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP3 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
seg AS (SELECT doc_id, n, o, substr(h, 2 * o + 1, 2 * (256 + 49)) AS h FROM (SELECT *, unnest(range(0, n - 49, 256)) AS o FROM t WHERE n >= 50)),
win AS (SELECT doc_id, o + i AS i, md5_number(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT *, unnest(range(0, least(256, n - 49 - o))) AS i FROM seg)),
least AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN least USING (g) WHERE doc_id > d),
isl AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k
        FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit)),
gone AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM isl GROUP BY doc_id, k),
cut AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS upto FROM gone),
kept AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * upto + 1, 2 * (b - upto)), '' ORDER BY b) AS front, max(e) AS last FROM cut JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS v, b AS r FROM edges UNION SELECT v, b FROM reach JOIN edges ON r = a),
c AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(r, w.doc_id)) AS component_id, least(w.doc_id, coalesce(r, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON v = w.doc_id
""".replace("{LOW}", LOW)

#: Base 32 of a digest: its 40 hexadecimal figures in groups of five, each of which is four letters.
_GROUP = "(" + " + ".join(f"(instr('0123456789abcdef', substr(h, g * 5 + {k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5)) + ")"
OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS best FROM p GROUP BY h),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (15 - 5 * k)) & 31) + 1, 1), '' ORDER BY g, k) AS digest
      FROM (SELECT h, g, {_GROUP}::BIGINT AS v FROM (SELECT h, unnest(range(0, 8)) AS g FROM m)), (SELECT unnest(range(0, 4)) AS k) GROUP BY h)
SELECT page_id, strlen(body) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN m USING (h) JOIN d USING (h)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
a AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM a JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
met AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN met ON met.lang = x.lang AND met.source = x.source AND met.item = y.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 10
""".replace("{LOW}", LOW)


def _clusters(rounds: int = 10, k: int = 8) -> str:
    """Plain rounds, one after the other: every vector against every centroid."""
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        "k AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM k ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT n, c.c, {square} AS d FROM k, c{i} c QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c.c) = 1)")
        if i < rounds:
            sums = f"SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{i} JOIN k USING (n)) GROUP BY c, i"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM ({sums}) GROUP BY c UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN k USING (n) JOIN c{rounds} c ON c.c = a.c"""


OP12 = _clusters()

OP13 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(3 * total) OVER k AS capped, sum(w) OVER k AS cw, lead(3 * total) OVER k AS next, lead(w) OVER k AS nw, sum(total) OVER () AS t, sum(w) OVER () AS tw
      FROM s WINDOW k AS (ORDER BY 3 * total / w, source NULLS LAST)),
-- Water level with the first k sources at their bound; the lowest k whose next source stays below its own.
lv AS (SELECT 0 AS k, any_value(t)::DOUBLE / any_value(tw)::DOUBLE AS lam, arg_min(3 * total, 3 * total / w) AS next, arg_min(w, 3 * total / w) AS nw FROM o
       UNION ALL SELECT row_number() OVER (ORDER BY 3 * total / w, source NULLS LAST), (t - capped)::DOUBLE / (tw - cw)::DOUBLE, next, nw FROM o),
lam AS (SELECT coalesce(arg_min(lam, k), 0) AS lam FROM lv WHERE next > lam * nw),
g AS (SELECT source, total, least((3 * total)::DOUBLE, lam * w) AS target, ('0x' || substr(sha256('mix:' || coalesce('=' || source, '')), 1, 8))::BIGINT % 1073741824 AS u FROM s, lam),
e AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE floor(target / total * 1073741824)::HUGEINT END AS each FROM g),
r AS (SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) AS r FROM d),
n AS (SELECT doc_id, size, total AS source_size, target, (r * each + u) // 1073741824 - ((r - 1) * each + u) // 1073741824 AS copies FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM n
"""

ALL: dict[str, str] = {
    "op3_suffix_dedup": OP3, "op4_minhash_near_dedup": OP4, "op5_quality_rules": OP5, "op6_warc": OP6, "op9_decontaminate": OP9,
    "op11_source_divergence": OP11, "op12_centroid_clusters": OP12, "op13_source_mix": OP13,
}
