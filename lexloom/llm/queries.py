"""Queries of the training-data operators: thin digests of their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import ann, line_dedup, mixing, neardup, quality, sentencepiece_lattice, substring_dedup, token_counts, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "llr")


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, F.col("vec_id") % 50 == 0)


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high", "word_log_ppl", "word_high")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_lattice.encode(docs).select("doc_id", "ids", "n_pieces", "round_trip")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, whole_runs=True).select("doc_id", "n_lines", "n_removed", "spans", "text")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, sum(2.0::DOUBLE * source_size) OVER r AS held, sum(weight) OVER () - sum(weight) OVER r AS w_left,
             sum(2.0::DOUBLE * source_size) OVER b AS held_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE) AS w_before,
             1.5::DOUBLE * sum(source_size) OVER () AS total
      FROM w WINDOW r AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING),
                    b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * ((total - coalesce(held_before, 0.0::DOUBLE)) / w_before) > 2.0::DOUBLE * source_size AS capped FROM o),
l AS (SELECT any_value((total - coalesce(h, 0.0::DOUBLE)) / wl) AS level
      FROM (SELECT max(total) AS total, sum(2.0::DOUBLE * source_size) FILTER (capped) AS h, sum(weight) FILTER (NOT capped) AS wl FROM c)),
t AS (SELECT source, source_size, CAST(CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE weight * level END AS DOUBLE) AS target FROM c, l),
r AS (SELECT d.doc_id, d.text, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM r
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 70 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""

OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT k FROM v GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM v SEMI JOIN r USING (k)),
x AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_perplexity": op3_perplexity,
    "op4_mixing": op4_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_url_filter": op8_url_filter,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}
ORACLE_SQL = {"op2_minhash_neardup": OP2_SQL, "op4_mixing": OP4_SQL, "op9_substring_dedup": OP9_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE_SQL)
