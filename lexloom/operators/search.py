"""Boolean, phrase and batch search: each result is a DataFrame of ``doc_id``.

Cases: queries without terms find nothing; duplicate terms count once; a phrase
is only a wholly quoted query, matched inside one field; an empty list of
queries finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import analyzer as A
from lexloom.operators.index import Index

_GAP = "\x1f"


def nothing(index: Index) -> DataFrame:
    return index.doc_tokens.sparkSession.createDataFrame([], "doc_id long")


def term_postings(index: Index, term: str) -> DataFrame:
    """Documents of one exact term."""
    return index.postings([term]).select("doc_id")


def all_terms(index: Index, terms: list[str]) -> DataFrame:
    """Documents that hold every one of the distinct terms."""
    if not terms:
        return nothing(index)
    if index.stored is None:
        return index.holding(terms).select("doc_id")
    found = index.postings(terms).groupBy("doc_id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(terms)).select("doc_id")


def has_phrase(positional: list[str], tokens: Column | None = None) -> Column:
    """Whether the tokens hold the given ones side by side."""
    joined = F.concat(F.lit(_GAP), F.array_join(F.col("tokens") if tokens is None else tokens, _GAP), F.lit(_GAP))
    return F.contains(joined, F.lit(_GAP + _GAP.join(positional) + _GAP))


def holds_phrase(terms: list[str], positional: list[str]) -> Column:
    """The same for a row that must hold all of the phrase's terms; joins no tokens of rows that don't."""
    held = F.concat("tokens", "grams")
    return F.when(reduce(Column.__and__, [F.array_contains(held, t) for t in terms]), has_phrase(positional)).otherwise(False)


def search(index: Index, query: str) -> DataFrame:
    """Documents that match one query: all its terms, or its quoted phrase."""
    terms, positional, phrase = A.py_query(query, index.min_term, index.max_cjk)
    if not terms:
        return nothing(index)
    if not phrase:
        return all_terms(index, terms)
    if index.stored is None:
        return index.holding(terms).where(has_phrase(positional)).select("doc_id")
    return index.documents(holds_phrase(terms, positional).alias("ok")).where("ok").select("doc_id")


def search_and(index: Index, queries: list[str]) -> DataFrame:
    """Intersection of full searches."""
    if not queries:
        return nothing(index)
    found = [search(index, q) for q in dict.fromkeys(queries)]
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), found)


def search_or(index: Index, queries: list[str]) -> DataFrame:
    """Union of full searches."""
    if not queries:
        return nothing(index)
    return reduce(DataFrame.unionByName, [search(index, q) for q in dict.fromkeys(queries)]).distinct()


def search_batch(index: Index, queries: list[str]) -> DataFrame:
    """``query_id, doc_id`` of many queries in one job, ids in list order.

    Terms of all queries but phrases are read from the postings once and joined to
    the query table, whose size is that of the list; documents are read once for
    all phrases, whose terms are looked for in the row.
    """
    spark = index.doc_tokens.sparkSession
    parsed = [A.py_query(q, index.min_term, index.max_cjk) for q in queries]
    phrases = {i: (terms, positional) for i, (terms, positional, phrase) in enumerate(parsed) if phrase and terms}
    wanted = [(i, t, len(terms)) for i, (terms, _, _) in enumerate(parsed) if i not in phrases for t in terms]
    found = spark.createDataFrame([], "query_id int, doc_id long")
    if phrases:
        rows = F.filter(F.array(*[F.when(holds_phrase(*p), F.lit(i)) for i, p in phrases.items()]), lambda i: i.isNotNull())
        found = index.documents(rows.alias("query_ids")).select(F.explode("query_ids").alias("query_id"), "doc_id")
    if not wanted:
        return found
    asked = spark.createDataFrame(wanted, "query_id int, term string, need int")
    hit = index.postings(sorted({t for _, t, _ in wanted})).join(F.broadcast(asked), "term")
    plain = hit.groupBy("query_id", "doc_id", "need").agg(F.count("*").alias("n")).where("n = need").select("query_id", "doc_id")
    return plain.unionByName(found) if phrases else plain


def _ids(spark, ids) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).distinct()
    return spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], T.StructType([T.StructField("doc_id", T.LongType())]))


def filter_by_ids(result: DataFrame, ids) -> DataFrame:
    """Results that are also in a list or a DataFrame of ids."""
    return result.join(_ids(result.sparkSession, ids), "doc_id", "left_semi")


def exclude_ids(result: DataFrame, ids) -> DataFrame:
    return result.join(_ids(result.sparkSession, ids), "doc_id", "left_anti")
