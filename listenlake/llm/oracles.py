"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, row_number() OVER o AS place_, 3.0::DOUBLE * source_size / weight AS full_,
    (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)),
goal AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(3.0::DOUBLE * source_size,
    weight * (SELECT arg_min(level, place_) FROM levels WHERE level <= full_)) END AS target FROM levels),
rates AS (
  SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS whole FROM goal),
leaning AS (
  SELECT s.source, sqrt(size::DOUBLE) AS lean, row_number() OVER w AS i, r.target - r.whole * r.source_size AS rest,
    coalesce(sum(size::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(sqrt(size::DOUBLE) * size) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source WHERE size > 0 AND r.target - r.whole * r.source_size > 0
  WINDOW w AS (PARTITION BY s.source ORDER BY size DESC, doc_id)),
factors AS (
  SELECT source, arg_min((rest - before) / after, i) AS factor FROM leaning WHERE (rest - before) / after * lean < 1 GROUP BY source),
ranked AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
    CASE WHEN factor * s.lean >= 1 THEN 0.0::DOUBLE ELSE s.u / (1 - s.u) / (factor * s.lean / (1 - factor * s.lean)) END AS rank
  FROM (SELECT *, sqrt(greatest(size, 1)::DOUBLE) AS lean FROM sized) s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN factors f ON s.source IS NOT DISTINCT FROM f.source),
open1 AS (
  SELECT doc_id, source, size, rank, rest AS gap FROM ranked WHERE rest > 0 AND size > 0 AND size <= rest),
upto1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id) AS upto FROM open1),
open2 AS (SELECT doc_id, source, size, rank, upto > gap AS out_, gap - max(CASE WHEN upto <= gap THEN upto ELSE 0 END) OVER (PARTITION BY source) AS gap FROM upto1),
upto2 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id) AS upto FROM open2 WHERE out_ AND size <= gap),
open3 AS (SELECT doc_id, source, size, rank, upto > gap AS out_, gap - max(CASE WHEN upto <= gap THEN upto ELSE 0 END) OVER (PARTITION BY source) AS gap FROM upto2),
upto3 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id) AS upto FROM open3 WHERE out_ AND size <= gap),
open4 AS (SELECT doc_id, source, size, rank, upto > gap AS out_, gap - max(CASE WHEN upto <= gap THEN upto ELSE 0 END) OVER (PARTITION BY source) AS gap FROM upto3),
upto4 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id) AS upto FROM open4 WHERE out_ AND size <= gap),
took AS (
  SELECT doc_id FROM upto1 WHERE upto <= gap UNION SELECT doc_id FROM upto2 WHERE upto <= gap UNION SELECT doc_id FROM upto3 WHERE upto <= gap UNION SELECT doc_id FROM upto4 WHERE upto <= gap)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN doc_id IN (SELECT doc_id FROM took) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM ranked
"""

OP6 = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
named AS (
  SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM parts),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS ruled FROM named JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
known AS (
  SELECT n.*, rule, ruled, regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '*', 'g') AS general FROM named n LEFT JOIN fits USING (page_id)),
walk AS (
  SELECT DISTINCT host, general, 0 AS depth, '' AS done, '' AS above, string_split(general, '/') AS rest FROM known
  UNION ALL
  SELECT host, general, depth + 1, done || '/' || CASE WHEN count(DISTINCT rest[1]) OVER (PARTITION BY host, done) > 50 THEN '*' ELSE rest[1] END, done, rest[2:]
  FROM walk WHERE len(rest) > 0),
labels AS (
  SELECT host, general, count(*) FILTER (ruled = 'block') AS bad, count(*) FILTER (ruled = 'allow') AS good FROM known GROUP BY ALL),
nodes AS (
  SELECT host, depth, above, done, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(bad + good) AS BIGINT) AS n, (sum(bad) + 1.0::DOUBLE) / (sum(bad + good) + 2.0::DOUBLE) AS share,
    CAST(coalesce(sum(bad + good) FILTER (len(rest) = 0), 0) AS BIGINT) AS own, CAST(coalesce(sum(good) FILTER (len(rest) = 0), 0) AS BIGINT) AS own_good
  FROM walk JOIN labels USING (host, general) GROUP BY ALL HAVING sum(bad + good) > 0),
below AS (
  SELECT host, depth - 1 AS depth, above AS done, CAST(sum(CAST(floor(n * 1000000.0::DOUBLE / (1.0::DOUBLE + (n - 1.0::DOUBLE) * 0.05::DOUBLE)) AS BIGINT)) AS BIGINT) AS weight,
    CAST(sum(CAST(floor((n - bad) * 1000000.0::DOUBLE / (1.0::DOUBLE + (n - 1.0::DOUBLE) * 0.05::DOUBLE)) AS BIGINT)) AS BIGINT) AS good_weight
  FROM nodes WHERE depth > 0 GROUP BY ALL),
weighed AS (
  SELECT n.*, coalesce(weight, 0) + CASE WHEN own > 0 THEN CAST(floor(own * 1000000.0::DOUBLE / (1.0::DOUBLE + (own - 1.0::DOUBLE) * 0.05::DOUBLE)) AS BIGINT) ELSE 0 END AS weight,
    coalesce(good_weight, 0) + CASE WHEN own > 0 THEN CAST(floor(own_good * 1000000.0::DOUBLE / (1.0::DOUBLE + (own - 1.0::DOUBLE) * 0.05::DOUBLE)) AS BIGINT) ELSE 0 END AS good_weight
  FROM nodes n LEFT JOIN below b ON n.host = b.host AND n.depth = b.depth AND n.done = b.done),
beside AS (
  SELECT *, lag(bad) OVER o AS bad_, lag(n) OVER o AS n_, (bad + lag(bad) OVER o + 1.0::DOUBLE) / (n + lag(n) OVER o + 2.0::DOUBLE) AS both_
  FROM weighed WINDOW o AS (PARTITION BY host, depth, above ORDER BY share, md5(done[2:]))),
split AS (
  SELECT *, CASE WHEN abs(bad / n::DOUBLE - bad_ / n_::DOUBLE) > 1.96::DOUBLE * sqrt(both_ * (1 - both_) * (1.0::DOUBLE / n + 1.0::DOUBLE / n_)) THEN 1 ELSE 0 END AS new_ FROM beside),
branches AS (
  SELECT *, sum(new_) OVER (PARTITION BY host, depth, above ORDER BY share, md5(done[2:])) AS branch FROM split),
pooled AS (
  SELECT host, depth, done, own, CAST(sum(n - bad) OVER w AS DOUBLE) AS good, CAST(sum(n) OVER w AS DOUBLE) AS n, sum(good_weight) OVER w / 1000000.0::DOUBLE AS g_, sum(weight) OVER w / 1000000.0::DOUBLE AS w_
  FROM branches WINDOW w AS (PARTITION BY host, depth, above, branch)),
pure AS (
  SELECT *, (g_ / w_ + 3.8416::DOUBLE / (2 * w_) + 1.96::DOUBLE * sqrt(g_ / w_ * (1 - g_ / w_) / w_ + 3.8416::DOUBLE / (4 * w_ * w_))) / (1 + 3.8416::DOUBLE / w_) AS bound FROM pooled),
steps AS (
  SELECT w.host, w.general, list({'g': good, 'n': n, 'e': 0.5::DOUBLE} ORDER BY w.depth) AS path, arg_max(bound, w.depth) AS bound, max(CASE WHEN len(rest) = 0 THEN own ELSE 0 END) AS own
  FROM walk w JOIN pure p ON w.host = p.host AND w.depth = p.depth AND w.done = p.done GROUP BY ALL),
ends AS (
  SELECT host, general, own, bound, list_reduce(path, lambda a, b: {'g': b.g, 'n': b.n, 'e': (a.g - b.g + 2 * a.e) / (a.n - b.n + 2)}) AS last FROM steps),
judged AS (
  SELECT host, general, CASE WHEN own > 0 THEN 0 ELSE bound END AS bound, (last.g + 2 * last.e) / (last.n + 2) AS purity FROM ends)
SELECT k.page_id, k.host, k.path, k.rule, coalesce(k.ruled, CASE WHEN purity < 0.35::DOUBLE AND bound < 0.35::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM known k LEFT JOIN judged j ON k.host = j.host AND k.general = j.general
"""

_OP13_ROUND = """
near{0} AS MATERIALIZED (
  SELECT row_, arg_min(c, d * 8 + c) AS c, min(d) AS d
  FROM (SELECT v.row_, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d FROM parts v JOIN mid{0} m USING (dim) GROUP BY ALL) GROUP BY row_),
moved{0} AS (
  SELECT n.c, dim, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM near{0} n JOIN parts USING (row_) GROUP BY ALL),
mid{1} AS MATERIALIZED (
  SELECT m.c, m.dim, CAST(coalesce((s - ((s % n) + n) % n) // n, m.x) AS BIGINT) AS x FROM mid{0} m LEFT JOIN moved{0} o ON o.c = m.c AND o.dim = m.dim),
"""

OP13 = (
    """
WITH kept AS MATERIALIZED (
  SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS row_ FROM embeddings WHERE len(embedding) = 64),
parts AS MATERIALIZED (
  SELECT row_, dim, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT row_, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM kept)
  WHERE row_ NOT IN (SELECT row_ FROM (SELECT row_, unnest(embedding) AS x FROM kept) WHERE x IS NULL OR NOT isfinite(x))),
first_ AS (
  SELECT row_, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept WHERE row_ IN (SELECT row_ FROM parts) QUALIFY c < 8),
mid0 AS MATERIALIZED (
  SELECT c, dim, x FROM first_ JOIN parts USING (row_)),"""
    + "".join(_OP13_ROUND.format(r, r + 1) for r in range(10))
    + """last_ AS MATERIALIZED (
  SELECT row_, arg_min(c, d * 8 + c) AS c, min(d) AS d
  FROM (SELECT v.row_, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d FROM parts v JOIN mid10 m USING (dim) GROUP BY ALL) GROUP BY row_),
names AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM mid10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM last_ JOIN kept USING (row_) JOIN names USING (c)
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": OP3, "op4_mixing": OP4, "op6_url_filters": OP6, "op13_centroid_clustering": OP13}
