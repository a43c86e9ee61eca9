"""BM25 over AND candidates.

Only the query's postings are read.  Corpus size, average length and document
frequencies are a row each for the corpus and a query term, and enter the plan
as literals.  Ties go to the smaller id.

Cases: no terms or limit 0 give no rows; n-grams of CJK runs select documents
but have no term frequency, so they add no score; a phrase filters documents
but leaves document frequencies as they are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import analyzer as A
from lexloom.operators import search as S
from lexloom.operators.index import Index

K1, B = 1.2, 0.75


def idf(n_docs: int, df: int) -> float:
    return math.log((n_docs - df + 0.5) / (df + 0.5) + 1.0)


def _count(term: str) -> Column:
    return F.size(F.filter("tokens", lambda x: x == term))


def search_scored(index: Index, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """``doc_id, score`` of every document that matches."""
    terms, positional, phrase = A.py_query(query, index.min_term, index.max_cjk)
    empty = index.doc_tokens.sparkSession.createDataFrame([], "doc_id long, score double")
    if not terms:
        return empty
    stored = index.stored is not None
    if stored:
        n_docs, total, df = index.statistics(terms)
    else:
        # one pass over the texts: a narrow row a document serves the statistics and the scores
        held = F.concat("tokens", "grams")
        rows = index.keep(index.doc_tokens.select(
            "doc_id", "dl", (S.has_phrase(positional) if phrase else F.lit(True)).alias("ok"),
            *[F.when(F.array_contains(held, t), _count(t)).alias(f"t{i}") for i, t in enumerate(terms)]))
        r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), *[F.count(f"t{i}").alias(f"d{i}") for i in range(len(terms))]).first()
        n_docs, total, df = r["n"], r["total"], {t: r[f"d{i}"] for i, t in enumerate(terms)}
    if not all(df.values()):
        return empty
    average = total / n_docs if n_docs else 0.0
    damp = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(average or 1.0))

    def part(term: str, tf: Column) -> Column:
        return F.lit(idf(n_docs, df[term])) * tf * F.lit(k1 + 1) / (tf + damp)

    # terms are added in one order, so equal documents get equal scores and ties are true ties
    if not stored:
        fits = reduce(Column.__and__, [F.col(f"t{i}").isNotNull() for i in range(len(terms))])
        return rows.where(fits & F.col("ok") & (F.col("dl") > 0)).select("doc_id", reduce(Column.__add__, [part(t, F.col(f"t{i}")) for i, t in enumerate(terms)]).alias("score"))
    each = [F.max(F.when(F.col("term") == t, part(t, F.col("tf")))).alias(f"p{i}") for i, t in enumerate(terms)]
    scored = index.postings(terms).where("dl > 0").groupBy("doc_id").agg(F.count("*").alias("n"), *each).where(F.col("n") == len(terms))
    scored = scored.select("doc_id", reduce(Column.__add__, [F.col(f"p{i}") for i in range(len(terms))]).alias("score"))
    return scored.join(S.search(index, query), "doc_id", "left_semi") if phrase else scored


def search_ranked(index: Index, query: str, limit: int = 100) -> DataFrame:
    """``doc_id, score, rank`` of the best ``limit`` documents."""
    best = search_scored(index, query).orderBy(F.desc("score"), "doc_id").limit(limit)
    # at most `limit` rows are numbered
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def search_top_n(index: Index, query: str, n: int = 10) -> DataFrame:
    """Ids of the best n documents, with their rank."""
    return search_ranked(index, query, n).select("doc_id", "rank")
