"""SQL that says the same as some of the queries, for DuckDB over the plain tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# CRC-32 byte by byte, over a table that eight shifts make.
RESAMPLING = rf"""WITH RECURSIVE shifts(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM shifts WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM shifts WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT {WORDS} AS w FROM benchmark),
words AS (SELECT DISTINCT unnest(w) AS w FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1),
        lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM words, steps),
f AS (SELECT r, unnest(w) AS w FROM d),
s AS (SELECT bucket, count(*) AS n FROM f JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
      / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t ON t.bucket = s.bucket),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT d.r, doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights ON weights.r = d.r),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored
  WHERE n_features >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN rank <= (SELECT count(*) FROM ranked) * 10 // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked ON ranked.r = scored.r"""

ROUNDS = 3


def _rounds() -> str:
    """Assignment and update, written out once for each round."""
    parts = []
    for k in range(ROUNDS + 1):
        parts.append(f"""p{k} AS (
  SELECT v.r, arg_min({{'c': c.c, 'd': e.d}}, e.d * 64 + c.c) AS a
  FROM v CROSS JOIN c{k} c, LATERAL (SELECT list_sum(list_transform(list_zip(v.x, c.x),
      lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) e
  GROUP BY v.r)""")
        if k < ROUNDS:
            parts.append(f"""s{k} AS (
  SELECT p.a.c AS c, i, sum(v.x[i])::BIGINT AS s, count(*) AS n
  FROM p{k} p JOIN v ON v.r = p.r, range(1, 65) t(i) GROUP BY p.a.c, i),
c{k + 1} AS (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{k} c
  LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY c) m ON m.c = c.c)""")
    return ",\n".join(parts)


CENTROIDS = f"""WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v
  WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id) LIMIT 16),
{_rounds()}
SELECT v.vec_id, p.a.c::INTEGER AS cluster, p.a.d::BIGINT AS distance,
       (sum(p.a.d) OVER (PARTITION BY p.a.c))::BIGINT AS cluster_inertia, (sum(p.a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM p{ROUNDS} p JOIN v ON v.r = p.r JOIN c{ROUNDS} c ON c.c = p.a.c"""

SUBSTRINGS = r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS x
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL)),
least AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x HAVING count(*) > 1),
gone AS (
  SELECT r, list(DISTINCT j) AS js FROM (
    SELECT win.r, unnest(range(i, i + 13)) AS j FROM win JOIN least ON least.x = win.x WHERE win.doc_id > m)
  GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE
         list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(js, i)))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.r = d.r"""
