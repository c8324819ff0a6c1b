"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_text, ngram_join, quality, sentencepieces, substring_dedup, tiff
from .common import table
from .line_dedup import with_kept
from .mixing import mix
from .secret_scan import RULES, scan_increments

#: The model of the SentencePiece queries, in a folder of public tokenizers.
MODEL = os.environ.get("RIVULET_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, threshold=(90, 100))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.kept_words(table(spark, sf_dir, "documents"), digest=True)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2))  # a history of two increments, with the ledger between them
    found, _ = scan_increments([docs.where(half == 0), docs.where(half == 1)], carry=["doc_id"])
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES]
    return found.select("row.doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.summary(table(spark, sf_dir, "documents"), MODEL).withColumnRenamed("id", "doc_id")


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    return tiff.digests(tiff.encode(docs, keep_text=False)).withColumnRenamed("id", "doc_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars"), "n_repeated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores, key = quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select(F.col("id").alias("doc_id"), "score", "key", (F.col("key") >= F.lit(key)).alias("kept"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_kept(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


SQL: dict[str, str] = {}

SQL["op1_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

SQL["op2_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(list_transform(s, lambda g: hash(g))) AS h FROM s),
f AS (SELECT h, count(*) AS c FROM x GROUP BY h HAVING count(*) > 1),
o AS (SELECT x.doc_id, x.n, x.h, row_number() OVER (PARTITION BY x.doc_id ORDER BY coalesce(f.c, 1), x.h) AS pos FROM x LEFT JOIN f ON f.h = x.h),
p AS (SELECT * FROM o WHERE pos <= n - (n * 9 + 9) // 10 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9),
i AS (SELECT c.a, c.b, count(*) AS joint FROM c JOIN x p ON p.doc_id = c.a JOIN x q ON q.doc_id = c.b AND q.h = p.h GROUP BY c.a, c.b),
l AS (SELECT i.a, i.b FROM i JOIN s p ON p.doc_id = i.a JOIN s q ON q.doc_id = i.b WHERE 100 * joint >= 90 * (len(p.s) + len(q.s) - joint)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id FROM s LEFT JOIN m ON m.a = s.doc_id
"""

SQL["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
o AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
b AS (SELECT g.doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM g JOIN o ON o.h = g.h AND o.low < g.doc_id GROUP BY g.doc_id),
x AS (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS i FROM d WHERE len(d.w) > 0),
y AS (SELECT b.doc_id, unnest(gone) AS i FROM b),
k AS (SELECT x.doc_id, count(*) AS n, count(y.i) AS gone, string_agg(x.w[x.i], ' ' ORDER BY x.i) FILTER (y.i IS NULL) AS kept
      FROM x LEFT JOIN y ON y.doc_id = x.doc_id AND y.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(k.n, 0) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

SQL["op4_secret_scan"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT * FROM (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
  (2, 'hex', '[0-9a-f]{24,}', 0, 24)) t(nth, kind, re, g, least)),
m AS (SELECT doc_id, nth, kind, least, text, regexp_extract_all(text, re, 0) AS found,
             regexp_extract_all(text, re, g) AS val, regexp_split_to_array(text, re) AS gaps
      FROM d CROSS JOIN r WHERE regexp_matches(text, re)),
e AS (SELECT doc_id, nth, kind, least, i, length(found[i]) AS size, length(val[i]) AS vlen,
             list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS pos
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
f AS (SELECT doc_id, kind, nth, CAST(pos AS BIGINT) AS s, CAST(pos + size AS BIGINT) AS t FROM e WHERE vlen >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || t, ',' ORDER BY s, nth) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

SQL["op5_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size,
        -ln((CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(text)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
        / coalesce(1.0::DOUBLE - 0.9::DOUBLE * length(regexp_replace(text, '[\p{L} \n]+', '', 'g')) / nullif(length(text), 0), 0.1::DOUBLE) AS key
      FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS most, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
x AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM w),
y AS (SELECT *, max(CASE WHEN lev * w <= most THEN lev END) OVER () AS level FROM x),
g AS (SELECT source, source_size, round(least(most, coalesce(level * w, most)), 6) AS target FROM y),
e AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS epochs FROM g),
c AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key) - k.size AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(rest - before))) AS BIGINT) AS taken
FROM c
"""

SQL["op10_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.line, k.pos, (r.last IS NULL OR k.doc_id = r.last) AS keep FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
