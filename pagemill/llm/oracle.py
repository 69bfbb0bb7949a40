"""DuckDB SQL of the queries that SQL can express over whole tables.

The others are held against brute force in the tests: token ids (1), spans by code
point (3), the trained models (4, 8) and every 200-byte window of the corpus (6).
"""

from __future__ import annotations

from pagemill.llm.sharding import SHARDS, TABLE_SIZE, fill_table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {}

SQL["op5_sharding"] = f"""
WITH d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot
           FROM documents)
SELECT doc_id, slot, CAST(({fill_table([f"shard-{i}" for i in range(SHARDS)], TABLE_SIZE)})[slot + 1] AS INTEGER) AS shard FROM d
"""

SQL["op7_quality_rules"] = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
m AS (SELECT r, doc_id, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS upper, length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS letters,
             len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS echo
      FROM w),
win AS (SELECT r, i, words[i:i + 7] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
x AS (SELECT m.*, coalesce(rep.n, 0) AS n_repeat_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 30 * n_words) AND NOT (100 * n_dup_lines > 50 * len(lines))
         AND NOT (100 * echo > 40 * n_words) AND NOT (100 * upper > 50 * letters) AS kept
FROM f
"""

SQL["op9_source_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
b AS (SELECT *, row_number() OVER up AS o,
             CAST(sum(total) OVER () - coalesce(sum(3 * total) OVER before, 0) AS BIGINT) AS words_left,
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_left
      FROM w WINDOW up AS (ORDER BY total / weight, source NULLS LAST),
                    before AS (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(words_left AS HUGEINT) * weight >= CAST(3 * total AS HUGEINT) * weight_left AS capped FROM b),
t AS (SELECT source, total, CASE WHEN capped THEN CAST(3 * total AS DOUBLE) ELSE
        (SELECT CAST(words_left AS DOUBLE) / weight_left FROM c WHERE NOT capped ORDER BY o LIMIT 1) * weight END AS target FROM c),
e AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE CAST(least(floor(target / total), 3) AS BIGINT) END AS whole FROM t),
u AS (SELECT *, sum(n * size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - n * size AS start
      FROM (SELECT source, k, doc_id, size, count(*) AS n FROM d GROUP BY ALL)),
p AS (SELECT d.*, e.total, e.target, e.whole, CASE WHEN e.whole < 3 THEN e.target - e.whole * e.total ELSE 0 END AS rest, u.start, u.n
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
      JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.k = u.k AND d.doc_id IS NOT DISTINCT FROM u.doc_id AND d.size = u.size)
SELECT doc_id, size, total AS source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(round((rest - CAST(start AS DOUBLE)) / n) AS BIGINT))) AS BIGINT) AS taken
FROM p
"""

SQL["op10_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                         AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM v JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

SQL["op2_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) < 5 THEN [words] ELSE
             list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4]) END AS bag FROM w),
u AS (SELECT doc_id, unnest(bag) AS s FROM g),
c AS (SELECT doc_id, s, count(*) AS n FROM u GROUP BY ALL),
z AS (SELECT doc_id, len(bag) AS n FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS k FROM c a JOIN c b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE CAST(k AS DOUBLE) / (x.n + y.n - k) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reach GROUP BY a
"""

_FOLDED = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

SQL["op11_benchmark_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLDED} AS w FROM benchmark),
g AS MATERIALIZED (SELECT DISTINCT item, least(10, len(w)) AS n, w[p:p + least(10, len(w)) - 1] AS gram
                   FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)),
x AS (SELECT r, n, p, w[p:p + n - 1] AS gram
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS MATERIALIZED (SELECT r, p, n, item FROM x JOIN g USING (n, gram)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


def _lloyd(rounds: int = 5, k: int = 40, dims: int = 64) -> str:
    """Lloyd rounds one after the other, as a chain of tables."""
    def nearest(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT r, c, d FROM (SELECT v.r, c{i}.c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    tables = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v FROM v QUALIFY c < {k})"""]
    for i in range(rounds):
        tables += [nearest(i), f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v
    FROM (SELECT c, j, sum(v.v[j]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, {dims + 1}) t(j) GROUP BY c, j) GROUP BY c) m USING (c))"""]
    return "WITH " + ",\n".join([*tables, nearest(rounds)]) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)
"""


SQL["op12_centroid_clustering"] = _lloyd()
