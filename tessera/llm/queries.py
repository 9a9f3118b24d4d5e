"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, decontaminate, html_text, license_scan, lm_score, quality, simhash, suffix_repeats, topk, toxicity
from ..sources.shared import materialize
from .common import SPACES, crc_fold, table, word_count


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    out = toxicity.scored(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=2, shingle=3))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # every text is read once; what the mix needs of it is narrow
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text"), SPACES).alias("words")))
    return curriculum.digest(curriculum.curriculum(sizes, size=F.col("words")))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), order=3, backoff=0.4)
    return out.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    out = quality.scored(docs, weights, ["doc_id"])
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.detections(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.digest(suffix_repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), window=8))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_simhash, op3_mix, op4_lm_score, op5_quality, op6_licenses, op7_repeats, op8_topk, op9_main_text, op10_decontaminate)
}

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS k_null, coalesce(source, '') AS k_source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
s AS (SELECT k_null, k_source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY k_null, k_source) - 1 AS rank FROM s),
w AS (SELECT *, [5, 2, 1][CAST(rank % 3 AS INTEGER) + 1] AS w, CAST(3 * s AS DOUBLE) / [5, 2, 1][CAST(rank % 3 AS INTEGER) + 1] AS full_at FROM r),
l AS (SELECT *, CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
      FROM w WINDOW b AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT (SELECT arg_min(level, (full_at, rank)) FROM l WHERE full_at >= level) AS chosen),
t AS (SELECT k_null, k_source, s, rank, CASE WHEN chosen IS NULL OR full_at < chosen THEN CAST(3 * s AS DOUBLE) ELSE chosen * w END AS target FROM l, c),
p AS (SELECT d.*, s, rank, target, CAST(floor(target) AS BIGINT) AS goal,
             CAST(coalesce(sum(size) OVER (PARTITION BY k_null, k_source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t USING (k_null, k_source))
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(passes * size + part AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
       CASE WHEN copies > 0 THEN round(CASE WHEN ramp = 0 THEN u_first ELSE (2 * u_first) / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u_first)) END, 6) END AS first_position,
       CASE WHEN copies > 0 THEN round(CASE WHEN ramp = 0 THEN u_last ELSE (2 * u_last) / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u_last)) END, 6) END AS last_position
FROM (SELECT *, (start + (CASE WHEN passes > 0 THEN size ELSE part END) / 2.0::DOUBLE) / goal AS u_first,
             (CASE WHEN part > 0 THEN passes * s + start + part / 2.0::DOUBLE ELSE (passes - 1) * s + start + size / 2.0::DOUBLE END) / goal AS u_last,
             CASE WHEN size > 0 THEN passes ELSE 0 END + CASE WHEN part > 0 THEN 1 ELSE 0 END AS copies
      FROM (SELECT *, CASE WHEN s = 0 THEN 0 ELSE greatest(0, least(size, goal - passes * s - start)) END AS part
            FROM (SELECT *, CASE WHEN s = 0 THEN 0 ELSE goal // s END AS passes, [-0.6::DOUBLE, 0, 0.6][CAST(rank % 3 AS INTEGER) + 1] AS ramp FROM p)))
"""

#: The pages of the driver have their text in one article element without furniture inside; blocks are parted by p and h1.
PAGES_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.r <> v.r AND len(q.e) = len(v.e)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20
"""

DECONTAMINATE_SQL = r"""
WITH lowered AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark WHERE item_id IS NOT NULL),
pats AS (SELECT DISTINCT item, least(8, len(w)) AS m, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS p
         FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM pats),
grams AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
          FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lowered, sizes WHERE len(w) >= m)),
hits AS (SELECT r, i, m, item FROM grams JOIN pats USING (m, p)),
n AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hits GROUP BY r),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM lowered LEFT JOIN n USING (r) LEFT JOIN h USING (r)
"""

#: Bytes as pairs of hexadecimal digits, so that places are counted in bytes; texts in chunks, since a place deep in a long string is slow to reach.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, doc_id, q, substr(x, 1024 * q + 1, 2 * (512 + 49)) AS y FROM (SELECT *, unnest(range(0, length(x) // 1024 + 1)) AS q FROM d)),
w AS (SELECT r, doc_id, 512 * q + o AS p, substr(y, 2 * o + 1, 100) AS k FROM (SELECT *, unnest(range(0, least(512, length(y) // 2 - 49))) AS o FROM c)),
m AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
g AS (SELECT r, p FROM w JOIN m USING (k) WHERE least < doc_id),
s AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM g),
n AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY p) AS span FROM s),
e AS (SELECT r, span, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY r, span),
q AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS firsts, list(b ORDER BY a) AS ends FROM e GROUP BY r),
k AS (SELECT d.r, doc_id, x, n_removed, n_spans,
             CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, n_spans + 1),
               lambda i: substr(x, 2 * (CASE WHEN i = 0 THEN 0 ELSE ends[i] END) + 1, 2 * ((CASE WHEN i = n_spans THEN length(x) // 2 ELSE firsts[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE ends[i] END)))), '') END AS y
      FROM d LEFT JOIN q USING (r))
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(y)) AS kept_sha256 FROM k
"""

LM_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT sum(len(w)) AS tokens FROM t),
p AS (SELECT r, len(w) AS size, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c
      FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)),
q AS (SELECT r, size, i,
        count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY a, r) AS c1,
        CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY b, r) END AS c2,
        CASE WHEN c IS NOT NULL THEN count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, r) END AS c3
      FROM p),
l AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY r ORDER BY i) AS p2 FROM q),
s AS (SELECT r, CASE WHEN c3 > 0 AND p2 > 0 THEN ln(c3::DOUBLE / p2)
        WHEN c2 > 0 AND p1 > 0 THEN ln(c2::DOUBLE / p1) + CASE WHEN i > 2 THEN ln(0.4::DOUBLE) ELSE 0 END
        ELSE ln((CASE WHEN c1 > 0 THEN c1 ELSE 0.5 END)::DOUBLE / greatest(1, tokens - size)) + least(i - 1, 2) * ln(0.4::DOUBLE) END AS x FROM l, n),
g AS (SELECT r, sum(x) AS x FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(x, 0), 4)::DOUBLE AS log_score, round(x / len(w), 6)::DOUBLE AS mean_log_score FROM t LEFT JOIN g USING (r)
"""

ORACLE = {"op4_lm_score": LM_SQL, "op3_mix": MIX_SQL, "op7_repeats": REPEATS_SQL, "op6_licenses": license_scan.sql(), "op8_topk": TOPK_SQL, "op9_main_text": PAGES_SQL, "op10_decontaminate": DECONTAMINATE_SQL}
