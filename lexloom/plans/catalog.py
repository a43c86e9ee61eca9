"""Registered queries of the search engine and their oracle SQL.

Each query runs over its whole tables.  Limits stand only where they are the
operator (top, page, ranked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import analyzer as A
from lexloom.functions import text as X
from lexloom.operators import fuzzy, idset, index, rank, search
from lexloom.operators.result import ResultHandle
from lexloom.plans import sql as Q
from lexloom.sources import importers, store

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_TOK = Q.token_ctes()


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built(spark: SparkSession, sf_dir: str) -> index.Index:
    """The unstored index of all documents, spread for tokenizing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slots = spark.sparkContext.defaultParallelism
    if len(docs.inputFiles()) < slots:  # a small file is one task; larger tables split by themselves
        docs = docs.repartition(slots)
    return index.Index.build(docs, ["text"])


# ---- analysis and index construction


@query(f"WITH {_TOK} SELECT doc_id, CAST(len(tokens) AS INTEGER) AS dl, array_to_string(tokens, ' ') AS tokens FROM tok")
def analyze_tokens(spark, sf_dir):
    return built(spark, sf_dir).doc_tokens.select("doc_id", "dl", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {_TOK} SELECT doc_id, array_to_string(list_sort(list_distinct(tokens)), ' ') AS terms FROM tok")
def analyze_terms(spark, sf_dir):
    d = built(spark, sf_dir).doc_tokens
    return d.select("doc_id", F.array_join(A.terms(d), " ").alias("terms"))


@query(f"WITH {_TOK}, {Q.posting_ctes()} SELECT term, doc_id, tf FROM post")
def postings_build(spark, sf_dir):
    return built(spark, sf_dir).postings().select("term", "doc_id", "tf")


@query(f"WITH {_TOK}, {Q.posting_ctes()} SELECT term, count(*) AS df, CAST(len(term) AS INTEGER) AS len FROM post GROUP BY term")
def term_stats(spark, sf_dir):
    return index.term_stats(built(spark, sf_dir).postings())


@query(f"WITH {_TOK} SELECT count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS total_len FROM tok")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(built(spark, sf_dir).doc_tokens)


@query(f"WITH {_TOK} SELECT DISTINCT unnest(tokens) AS term FROM tok")
def all_terms(spark, sf_dir):
    return built(spark, sf_dir).postings().select("term").distinct()


# ---- boolean search


@query(f"WITH {_TOK} {Q.all_terms(['tion'])}")
def term_search(spark, sf_dir):
    return search.search(built(spark, sf_dir), "TION")


@query(f"WITH {_TOK} {Q.all_terms(['the', 'and', 'of'])}")
def and_search(spark, sf_dir):
    return search.search(built(spark, sf_dir), "the AND of")


@query(f"WITH {_TOK} {Q.all_terms(['und'])} UNION {Q.all_terms(['les', 'la'])}")
def or_search(spark, sf_dir):
    return search.search_or(built(spark, sf_dir), ["und", "les la"])


@query(f"WITH {_TOK} {Q.phrase(['of', 'the'])}")
def phrase_search(spark, sf_dir):
    return search.search(built(spark, sf_dir), '"of the"')


@query(f"WITH {_TOK} {Q.phrase(['of', 'the'])} INTERSECT {Q.all_terms(['and', 'in'])}")
def multiword_and_of_phrases(spark, sf_dir):
    return search.search_and(built(spark, sf_dir), ['"of the"', "and in"])


@query(f"""WITH {_TOK} SELECT 0 AS query_id, doc_id FROM ({Q.all_terms(['the', 'and'])}) UNION ALL SELECT 1, doc_id FROM ({Q.phrase(['of', 'the'])})
UNION ALL SELECT 2, doc_id FROM ({Q.all_terms(['und', 'der'])})""")
def batch_search(spark, sf_dir):
    return search.search_batch(built(spark, sf_dir), ["the and", '"of the"', "und der", "", "nosuchterm"])


# ---- ranking


@query(f"WITH {_TOK}, {Q.scored(['the', 'and', 'of'])} SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, doc_id LIMIT 100")
def ranked_bm25(spark, sf_dir):
    return rank.search_ranked(built(spark, sf_dir), "the and of", 100).withColumn("score", F.round("score", 6))


@query(f"WITH {_TOK}, {Q.scored(['und', 'der'])} SELECT doc_id, round(score, 6) AS score FROM scored")
def scored_bm25(spark, sf_dir):
    return rank.search_scored(built(spark, sf_dir), "und der").withColumn("score", F.round("score", 6))


@query(f"WITH {_TOK}, {Q.scored(['tion', 'the'])} SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, doc_id LIMIT 10")
def top_n_bm25(spark, sf_dir):
    return rank.search_top_n(built(spark, sf_dir), "tion the", 10)


@query(f"WITH {_TOK}, {Q.scored(['of', 'the'], Q.phrase(['of', 'the']))} SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, doc_id LIMIT 50")
def phrase_ranked(spark, sf_dir):
    return rank.search_ranked(built(spark, sf_dir), '"of the"', 50).withColumn("score", F.round("score", 6))


# ---- fuzzy

_CAND = r"""
words AS (SELECT unnest(['{words}']) AS word),
terms AS (SELECT DISTINCT unnest(tokens) AS term FROM tok),
near AS (SELECT word, term, levenshtein(regexp_replace(term, '[^\x00-\x7F]', '~', 'g'), word) AS distance, greatest(len(term), len(word)) AS longest FROM terms, words
         WHERE len(term) BETWEEN len(word) - 2 AND len(word) + 2),
cand AS (SELECT word, term, CAST(distance AS INTEGER) AS distance, 1.0::DOUBLE - distance / longest::DOUBLE AS similarity FROM near
         WHERE distance <= 2 AND 1.0::DOUBLE - distance / longest::DOUBLE >= 0.7
         QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, similarity DESC, term) <= 20)"""


def _cand(*words: str) -> str:
    return _CAND.format(words="', '".join(words))


@query(f"WITH {_TOK}, {_cand('thonin', 'antion', 'ouedly')} SELECT word, term, distance, round(similarity, 6) AS similarity FROM cand")
def fuzzy_candidates(spark, sf_dir):
    terms = built(spark, sf_dir).terms()
    return fuzzy.candidates(terms, ["thonin", "antion", "ouedly"]).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_TOK}, {_cand('thonin')} SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) JOIN cand USING (term)")
def fuzzy_search_single(spark, sf_dir):
    return fuzzy.fuzzy_search(built(spark, sf_dir), "thonin", min_results=1_000_000)[0]


@query(f"WITH {_TOK}, {_cand('antion', 'thonin')} SELECT doc_id FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) JOIN cand USING (term)) GROUP BY doc_id HAVING count(*) = 2")
def fuzzy_search_multi(spark, sf_dir):
    return fuzzy.fuzzy_matches(built(spark, sf_dir), "antion thonin")


# ---- results


def _handle(spark, sf_dir, q: str) -> ResultHandle:
    return ResultHandle(search.search(built(spark, sf_dir), q), q)


@query(f"WITH {_TOK} {Q.all_terms(['the'])} INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def filter_ids(spark, sf_dir):
    return _handle(spark, sf_dir, "the").filter_by_ids(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")).frame


@query(f"WITH {_TOK} {Q.all_terms(['the'])} EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def exclude_ids(spark, sf_dir):
    return _handle(spark, sf_dir, "the").exclude_ids(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")).frame


@query(f"WITH {_TOK} {Q.all_terms(['the'])} INTERSECT {Q.all_terms(['tion'])}")
def result_intersect(spark, sf_dir):
    return _handle(spark, sf_dir, "the").intersect(_handle(spark, sf_dir, "tion")).frame


@query(f"WITH {_TOK} {Q.all_terms(['les'])} UNION {Q.all_terms(['tion'])}")
def result_union(spark, sf_dir):
    return _handle(spark, sf_dir, "les").union(_handle(spark, sf_dir, "tion")).frame


@query(f"WITH {_TOK} {Q.all_terms(['the'])} EXCEPT {Q.all_terms(['tion'])}")
def result_difference(spark, sf_dir):
    return _handle(spark, sf_dir, "the").difference(_handle(spark, sf_dir, "tion")).frame


@query(f"WITH {_TOK} SELECT doc_id FROM ({Q.all_terms(['the'])}) ORDER BY doc_id LIMIT 100")
def result_top(spark, sf_dir):
    return _handle(spark, sf_dir, "the").top_frame(100)


@query(f"WITH {_TOK} SELECT doc_id FROM ({Q.all_terms(['the'])}) ORDER BY doc_id LIMIT 25 OFFSET 50")
def result_page(spark, sf_dir):
    return _handle(spark, sf_dir, "the").page_frame(50, 25)


@query(f"WITH {_TOK} SELECT CAST(CASE WHEN doc_id > 0 THEN (doc_id - 1) // 32768 + 1 ELSE 0 END AS BIGINT) AS bucket, count(*) AS ids FROM ({Q.all_terms(['the'])}) GROUP BY 1")
def idset_dense(spark, sf_dir):
    dense = idset.IdSet(search.search(built(spark, sf_dir), "the")).dense()
    return dense.select(F.col("bucket").cast("long").alias("bucket"), F.expr("bitmap_count(bitmap)").alias("ids"))


@query(f"WITH {_TOK} {Q.all_terms(['the'])}")
def idset_dense_read_back(spark, sf_dir):
    return idset.IdSet.from_dense(idset.IdSet(search.search(built(spark, sf_dir), "the")).dense()).frame


@query(f"WITH {_TOK} {Q.all_terms(['the'])} EXCEPT {Q.all_terms(['tion'])} EXCEPT SELECT 7 UNION SELECT 7 UNION SELECT 5000000000")
def idset_algebra(spark, sf_dir):
    own = built(spark, sf_dir)
    the, tion = (idset.IdSet(search.term_postings(own, t)) for t in ("the", "tion"))
    return ((the | tion) - tion).remove(7).add(7, 5_000_000_000).frame


@query(f"WITH {_TOK} {Q.all_terms(['the'])} INTERSECT {Q.all_terms(['and'])} INTERSECT {Q.all_terms(['in'])}")
def idset_intersection(spark, sf_dir):
    own = built(spark, sf_dir)
    return idset.intersection([idset.IdSet(search.term_postings(own, t)) for t in ("the", "and", "in")]).frame


@query(f"WITH {_TOK} {Q.all_terms(['und'])} UNION {Q.all_terms(['les'])} UNION {Q.all_terms(['los'])}")
def idset_union(spark, sf_dir):
    own = built(spark, sf_dir)
    return idset.union([idset.IdSet(search.term_postings(own, t)) for t in ("und", "les", "los")]).frame


# ---- fields and imports

_PART = ["p_name", "p_brand", "p_type"]


@query("WITH " + ", ".join(Q.token_ctes(f"SELECT p_partkey AS doc_id, {c} AS text FROM part", c) for c in _PART) + f"""
SELECT doc_id, array_to_string(list_filter([array_to_string(p_name.tokens, ' '), array_to_string(p_brand.tokens, ' '), array_to_string(p_type.tokens, ' ')], lambda x: x <> ''), ' | ') AS tokens
FROM p_name JOIN p_brand USING (doc_id) JOIN p_type USING (doc_id)""")
def field_boundary_tokens(spark, sf_dir):
    d = A.analyze(table(spark, sf_dir, "part"), _PART, "p_partkey")
    return d.select("doc_id", F.array_join(F.transform("tokens", lambda t: F.when(t == A.BOUNDARY, F.lit("|")).otherwise(t)), " ").alias("tokens"))


@query(r"""SELECT CAST(conv_id AS BIGINT) AS doc_id, coalesce(CAST(turn AS VARCHAR), '') AS text_0, coalesce(role, '') AS text_1, coalesce(text, '') AS text_2 FROM conversations""")
def import_columns(spark, sf_dir):
    return importers.prepare(table(spark, sf_dir, "conversations"), "conv_id")[0]


@query(r"""SELECT CAST(page_id AS BIGINT) AS doc_id, coalesce(url, '') AS text_0 FROM pages""")
def import_text_columns(spark, sf_dir):
    return importers.prepare(table(spark, sf_dir, "pages"), "page_id", ["url", "absent"])[0]


# ---- mutation: operations resolved by latest-wins


def _ops(spark, sf_dir) -> DataFrame:
    """All documents (1), German ones replaced (2), ``src1`` deleted (3), its French ones added again (4)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")

    def batch(seq: int, op: str, rows: DataFrame) -> DataFrame:
        return A.analyze(rows, ["text"]).select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), "doc_id", "tokens", "grams", "dl")

    return (
        batch(1, store.UPSERT, docs)
        .unionByName(batch(2, store.UPSERT, docs.where("lang = 'de'").withColumn("text", F.concat_ws(" ", F.lit("replaced by"), "source"))))
        .unionByName(batch(3, store.DELETE, docs.where("source = 'src1'").withColumn("text", F.lit(""))))
        .unionByName(batch(4, store.UPSERT, docs.where("source = 'src1' and lang = 'fr'").withColumn("text", F.lit("back again"))))
    )


_LIVE = f"""WITH {_TOK}, live AS (SELECT d.doc_id, CASE WHEN source = 'src1' THEN 4 WHEN lang = 'de' THEN 2 ELSE 1 END AS seq,
  CASE WHEN source = 'src1' THEN ['back', 'again'] WHEN lang = 'de' THEN list_filter(['replaced', 'by', source], lambda x: x IS NOT NULL) ELSE tokens END AS tokens
  FROM documents d JOIN tok USING (doc_id) WHERE NOT (coalesce(source, '') = 'src1' AND coalesce(lang, '') <> 'fr'))"""


@query(_LIVE + " SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(len(tokens) AS INTEGER) AS dl FROM live")
def update_latest_wins(spark, sf_dir):
    return store.live_documents(_ops(spark, sf_dir)).select("doc_id", "seq", "dl")


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND coalesce(lang, '') <> 'fr'")
def delete_tombstone(spark, sf_dir):
    return store.resolve(_ops(spark, sf_dir).select("doc_id", "seq", "op")).where(F.col("op") == store.DELETE).select("doc_id")


@query(_LIVE + " SELECT term, count(*) AS df, CAST(len(term) AS INTEGER) AS len FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM live) GROUP BY term")
def compact_live_terms(spark, sf_dir):
    return index.term_stats(index.postings(store.live_documents(_ops(spark, sf_dir)).drop("seq")))


# ---- text functions


def _pairs(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("a"), F.col("r_name").alias("b"))


_PAIRS = "FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT n_nationkey, CAST(levenshtein(n_name, r_name) AS INTEGER) AS distance {_PAIRS}")
def levenshtein(spark, sf_dir):
    return _pairs(spark, sf_dir).select("n_nationkey", X.levenshtein_distance(F.col("a"), F.col("b")).alias("distance"))


_LCS = f"""RECURSIVE p AS (SELECT n_nationkey, n_name AS a, r_name AS b {_PAIRS}),
r AS (SELECT n_nationkey, a, b, 1 AS d, [0 for j in range(0, len(b) + 1)] AS old, [0 for j in range(0, len(b) + 1)] AS now FROM p
  UNION ALL SELECT n_nationkey, a, b, d + 1, now, [CASE WHEN j = 0 OR d + 1 - j < 1 THEN 0 WHEN substr(a, d + 1 - j, 1) = substr(b, j, 1) THEN old[j] + 1 ELSE greatest(now[j + 1], now[j]) END for j in range(0, len(b) + 1)]
  FROM r WHERE d < len(a) + len(b)),
l AS (SELECT n_nationkey, a, b, CAST(now[len(b) + 1] AS INTEGER) AS lcs FROM r WHERE d = len(a) + len(b))"""


@query(f"WITH {_LCS} SELECT * FROM l")
def lcs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("n_nationkey", "a", "b", X.longest_common_subsequence(F.col("a"), F.col("b")).alias("lcs"))


@query(f"""WITH {_LCS}, s AS (SELECT *, greatest(len(a), len(b))::DOUBLE AS longest, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM l)
SELECT n_nationkey, a, b, round(greatest(1.0::DOUBLE - levenshtein(a, b) / longest, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, lcs / longest), 6) AS score FROM s""")
def similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("n_nationkey", "a", "b", F.round(X.similarity_score(F.col("a"), F.col("b")), 6).alias("score"))


@query("SELECT p_partkey, array_to_string([substr(p_name, CAST(i AS BIGINT), 3) for i in range(1, len(p_name) - 1)], '|') AS grams FROM part")
def ngrams(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.generate_ngrams(F.col("p_name"), 3), "|").alias("grams"))


@query("""SELECT p_partkey, array_to_string(list_concat([substr(p_brand, CAST(i AS BIGINT), 2) for i in range(1, len(p_brand))],
                                           [substr(p_brand, CAST(i AS BIGINT), 3) for i in range(1, len(p_brand) - 1)]), '|') AS grams FROM part""")
def ngram_range(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.generate_ngrams_range(F.col("p_brand"), 2, 3), "|").alias("grams"))


@query("""SELECT doc_id, array_to_string(list_filter([0, 1, 2, 3], lambda i: contains(text, ['the', 'zz', '', 'und'][CAST(i + 1 AS BIGINT)])), ',') AS found,
  starts_with(text, 'An') AS prefix, ends_with(text, '.') AS suffix, contains(text, 'tion') AS has FROM documents""")
def contains_any(spark, sf_dir):
    t = F.col("text")
    patterns = F.array(*[F.lit(p) for p in ("the", "zz", "", "und")])
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(X.contains_any_substring(t, patterns).cast("array<string>"), ",").alias("found"),
        X.has_prefix(t, F.lit("An")).alias("prefix"), X.has_suffix(t, F.lit(".")).alias("suffix"), X.contains_substring(t, F.lit("tion")).alias("has"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text FROM documents")
def normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_ws(F.col("text")).alias("text"))


_HAN = "concat('全文', text, ' 搜索', coalesce(source, ''), '引擎', lang)"


@query(rf"""SELECT doc_id, CAST(len(regexp_replace(s, '[^一-鿿]', '', 'g')) AS INTEGER) AS n, array_to_string(regexp_extract_all(s, '[一-鿿]+'), '|') AS segments,
  regexp_matches(left(s, 1), '^[一-鿿]$') AS first, regexp_matches(right(s, 1), '^[一-鿿]$') AS last FROM (SELECT doc_id, {_HAN} AS s FROM documents)""")
def chinese_segments(spark, sf_dir):
    s = F.col("s")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_HAN).alias("s"))
    return docs.select("doc_id", X.count_chinese_chars(s).alias("n"), F.array_join(X.extract_chinese_segments(s), "|").alias("segments"),
                       X.is_chinese_char(F.left(s, F.lit(1))).alias("first"), X.is_chinese_char(F.right(s, F.lit(1))).alias("last"))


@query(rf"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(lower(s), '[{A.CJK}]+')) AS run FROM (SELECT doc_id, {_HAN} AS s FROM documents)),
g AS (SELECT DISTINCT doc_id, substr(run, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS gram FROM r, (SELECT unnest([1, 2, 3, 4]) AS n), (SELECT unnest(range(1, 30)) AS i) WHERE i + n - 1 <= len(run))
SELECT doc_id, gram FROM g""")
def cjk_ngrams(spark, sf_dir):
    d = A.analyze(table(spark, sf_dir, "documents").select("doc_id", F.expr(_HAN).alias("s")), ["s"])
    return d.select("doc_id", F.explode(F.filter(A.terms(d), lambda t: t.rlike(f"^[{A.CJK}]"))).alias("gram"))


_WIDE = "'Ｈｅｌｌｏ　Ｗｏｒｌｄ １２ ﬃ ΣΑς '"


@query(f"WITH {Q.token_ctes(f'SELECT doc_id, concat({chr(39)}Hello World 12 ffi ΣΑς {chr(39)}, nfc_normalize(text)) AS text FROM documents')} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM tok")
def nfkc_fold(spark, sf_dir):
    """Wide letters, a ligature and a final sigma before every text; other texts are composed already."""
    d = A.analyze(table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat({_WIDE}, text)").alias("s")), ["s"])
    return d.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT doc_id, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS same, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS same32 FROM documents")
def fast_hash(spark, sf_dir):
    """Rows of equal hash: the hashes tell texts apart and agree on equal ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.fast_hash(F.col("text")).alias("h"), F.struct(X.fast_hash32(F.col("text")), F.length("text"), F.left("text", F.lit(50))).alias("h32"))
    out = docs
    for h, name in (("h", "same"), ("h32", "same32")):
        out = out.join(docs.groupBy(h).agg(F.count("*").alias(name)), h)
    return out.select("doc_id", "same", "same32")


# ---- the stored engine: flush, update, delete, search, compact


#: Engines by application, tables and state: queries of one session share a store, as an engine's user does.
_OPEN: dict = {}


def _stored(spark, sf_dir: str, changed: bool = False, compact: bool = False):
    key = (spark.sparkContext.applicationId, sf_dir, changed, compact)
    if key not in _OPEN:
        _OPEN[key] = _store(spark, sf_dir, changed, compact)
    return _OPEN[key]


def _store(spark, sf_dir: str, changed: bool, compact: bool):
    """An engine on all documents; ``changed``: German ones replaced and ``src1`` deleted in a second commit."""
    from lexloom.config import EngineConfig
    from lexloom.engine import SearchEngine

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    slots = spark.sparkContext.defaultParallelism
    docs = docs.repartition(slots) if len(docs.inputFiles()) < slots else docs
    e = SearchEngine(spark, EngineConfig.persistent(store.scratch(spark)))
    e.add_frame(docs, ["text"])
    e.flush()
    if changed:
        e.add_frame(docs.where("lang = 'de'").select("doc_id", F.concat_ws(" ", F.lit("replaced by"), "source").alias("text")), ["text"])
        e.remove_frame(docs.where("source = 'src1'").select("doc_id"))
        e.flush()
    if compact:
        e.compact()
    return e


_NOW = f"""WITH {_TOK.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN concat_ws(' ', 'replaced by', source) ELSE text END AS text FROM documents WHERE coalesce(source, '') <> 'src1')")}"""


@query(f"WITH {_TOK} {Q.all_terms(['the', 'tion'])}")
def stored_search(spark, sf_dir):
    return _stored(spark, sf_dir).search("The tion").frame


@query(f"{_NOW} {Q.all_terms(['replaced', 'by'])} UNION {Q.all_terms(['tion'])}")
def stored_update_search(spark, sf_dir):
    return _stored(spark, sf_dir, True).search_or(["replaced by", "tion"]).frame


@query(f"{_NOW} {Q.phrase(['of', 'the'])}")
def stored_compact_phrase(spark, sf_dir):
    return _stored(spark, sf_dir, True, True).search('"of the"').frame


@query(f"{_NOW}, {Q.scored(['tion', 'the'])} SELECT doc_id, round(score, 6) AS score FROM scored")
def stored_update_scored(spark, sf_dir):
    return _stored(spark, sf_dir, True).search_scored("tion the").withColumn("score", F.round("score", 6))


@query(f"{_NOW} SELECT DISTINCT unnest(tokens) AS term FROM tok")
def stored_compact_terms(spark, sf_dir):
    return _stored(spark, sf_dir, True, True).all_terms()


@query(f"WITH {_TOK}, {_cand('thonin')} SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) JOIN cand USING (term)")
def stored_fuzzy_search(spark, sf_dir):
    return _stored(spark, sf_dir).fuzzy_search("thonin", 1_000_000).frame


@query(f"""{_NOW} SELECT 0 AS query_id, doc_id FROM ({Q.all_terms(['the', 'and'])}) UNION ALL SELECT 1, doc_id FROM ({Q.phrase(['of', 'the'])})""")
def stored_batch(spark, sf_dir):
    found = _stored(spark, sf_dir, True).search_batch(["the and", '"of the"'])
    return found[0].frame.select(F.lit(0).alias("query_id"), "doc_id").unionByName(found[1].frame.select(F.lit(1).alias("query_id"), "doc_id"))


@query(f"""{_NOW} SELECT CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(len(tokens)) AS BIGINT) AS total_tokens, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM tok)) AS term_count,
  CAST(2 AS BIGINT) AS segment_count, CAST(0 AS BIGINT) AS buffered, (SELECT count(*) FROM ({Q.all_terms(['the'])})) AS hits, (SELECT min(doc_id) FROM ({Q.all_terms(['the'])})) AS first FROM tok""")
def stored_statistics(spark, sf_dir):
    e = _stored(spark, sf_dir, True)
    s, hits = e.stats(), e.search("the")
    first = hits.top(1)[0]
    row = (int(s["doc_count"]), int(s["total_tokens"]), int(s["term_count"]), int(s["segment_count"]), e.buffer_size(), hits.total_hits, first if hits.contains(first) else -1)
    return spark.createDataFrame([row], "doc_count long, total_tokens long, term_count long, segment_count long, buffered long, hits long, first long")
