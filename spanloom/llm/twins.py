"""DuckDB text of the queries that SQL can express on whole tables."""

from __future__ import annotations

# --- op11: edits are found as equal rests after one letter is left out ---

_RUN = "[A-Za-zÀ-ÿ]+"
_UPPER = "".join(map(chr, range(0x41, 0x5B)))

# crc32 by its definition: a table of 256 entries from the polynomial, then one step a byte.
_CRC_TABLE = """(SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b)
  FROM (SELECT unnest(range(256)) AS b))"""
_BYTES = "list_transform(range(octet_length(encode(s))), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"

OP11 = f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
runs AS MATERIALIZED (
  SELECT doc_id, translate(run, '{_UPPER}', '{_UPPER.lower()}') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUN}')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, times, {_CRC} AS h FROM (SELECT run, times, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, t FROM runs, tab)),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
rests AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT DISTINCT word, other FROM (
    SELECT a.word, b.word AS other FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT r.word, w.word FROM rests r JOIN words w ON r.rest = w.word
    UNION ALL SELECT w.word, r.word FROM rests r JOIN words w ON r.rest = w.word)),
near AS MATERIALIZED (
  SELECT p.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, encode(o.word)) AS best, max(o.n) AS best_n
  FROM pairs p JOIN words o ON p.other = o.word GROUP BY p.word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
led AS (SELECT word, word AS root FROM formed UNION ALL SELECT led.word, f.form FROM led JOIN formed f ON led.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT led.word, led.root FROM led JOIN formed e ON led.root = e.word WHERE e.form IS NULL) l ON f.word = l.word
"""

# --- op12: a row for each component, rounds one after another ---


def _rounds(k: int, rounds: int) -> str:
    out = [f"""
c0 AS MATERIALIZED (
  SELECT j, dim, x AS c FROM (SELECT vid, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j FROM kept) s JOIN cells USING (vid) WHERE j < {k})"""]
    for r in range(rounds + 1):
        out.append(f"""
d{r} AS (SELECT vid, j, sum((x - c) * (x - c)) AS d FROM cells JOIN c{r} USING (dim) GROUP BY vid, j),
a{r} AS MATERIALIZED (SELECT vid, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM d{r} GROUP BY vid)""")
        if r < rounds:
            out.append(f"""
m{r} AS (SELECT a.j, dim, sum(x) AS s, count(*) AS n FROM cells JOIN a{r} a USING (vid) GROUP BY a.j, dim),
c{r + 1} AS MATERIALIZED (SELECT o.j, o.dim, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} o LEFT JOIN m{r} USING (j, dim))""")
    return ",".join(out)


OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS vid, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
cells AS MATERIALIZED (SELECT vid, unnest(range(64)) AS dim, unnest(v) AS x FROM kept),
{_rounds(16, 3)},
per AS (SELECT j, sum(d) AS cluster_inertia FROM a3 GROUP BY j),
names AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY j)
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a3 a USING (vid) JOIN per ON a.j = per.j JOIN names ON a.j = names.j
"""

# --- op13: a window's words joined by blanks name it, since words hold none ---

OP13 = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT r, id, i, array_to_string(w[i + 1:i + 13], ' ') AS words FROM (SELECT r, id, w, unnest(range(len(w) - 12)) AS i FROM docs WHERE len(w) >= 13)),
least AS (SELECT words, min(id) AS least FROM windows GROUP BY words),
gone AS MATERIALIZED (SELECT DISTINCT r, i + o AS i FROM windows JOIN least USING (words), (SELECT unnest(range(13)) AS o) WHERE id > least),
each AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN gone USING (r, i) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""

ORACLES = {"op11_gram_variants": OP11, "op12_pca_centroids": OP12, "op13_cover_passages": OP13}
