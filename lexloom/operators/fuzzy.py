"""Fuzzy search: each raw word of the query expands to near terms.

Candidates are live terms within ``max_distance`` edits and above the similarity
threshold; the best ``max_candidates`` a word (distance, then similarity, then
the term itself) are looked up, united per word and intersected over the words.

Cases: a word without candidates makes the result empty (``legacy_reset`` drops
such a word instead if no document was left before it); ``min_results`` 0 never
turns fuzzy; words are compared as typed, not analyzed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import FuzzyConfig
from lexloom.operators import search as S
from lexloom.operators.index import Index


def candidates(terms: DataFrame, words: list[str], config: FuzzyConfig | None = None) -> DataFrame:
    """``word, term, distance, similarity`` of the kept candidates of each word.

    ``terms`` has distinct ``term``.  The words are literals of the query, so
    terms are scanned once and never shuffled; a length band comes before the
    bounded edit distance.
    """
    c = config or FuzzyConfig()
    words = list(dict.fromkeys(words))
    spark = terms.sparkSession
    if not words:
        return spark.createDataFrame([], "word string, term string, distance int, similarity double")
    size = F.char_length("term")
    near = [F.when(size.between(len(w) - c.max_distance, len(w) + c.max_distance), F.struct(F.lit(w).alias("word"), F.levenshtein("term", F.lit(w), c.max_distance).alias("distance"), F.greatest(size, F.lit(len(w))).alias("longest"))) for w in words]
    rows = F.filter(F.array(*near), lambda r: r.isNotNull() & (r["distance"] >= 0))
    found = terms.select("term", F.inline(rows)).withColumn("similarity", 1.0 - F.col("distance") / F.col("longest")).where(F.col("similarity") >= c.threshold)
    order = Window.partitionBy("word").orderBy("distance", F.desc("similarity"), "term")
    # the band and the distance bound leave few terms a word
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= c.max_candidates).select("word", "term", "distance", "similarity")


def fuzzy_matches(index: Index, query: str, config: FuzzyConfig | None = None, legacy_reset: bool = False) -> DataFrame:
    """Documents that hold a candidate of every word."""
    c = config or FuzzyConfig()
    words = list(dict.fromkeys(query.split()))
    if not words:
        return S.nothing(index)
    terms = index.terms()
    kept = [(r["word"], r["term"]) for r in candidates(terms, words, c).collect()]  # words x max_candidates rows
    per = {w: [t for x, t in kept if x == w] for w in words}
    spark = index.doc_tokens.sparkSession
    if not legacy_reset and not all(per.values()):
        return S.nothing(index)
    if legacy_reset:
        result = None
        for w in words:
            own = index.postings(per[w]).select("doc_id").distinct() if per[w] else S.nothing(index)
            result = own if result is None or result.isEmpty() else result.join(own, "doc_id", "left_semi")
        return result
    pairs = spark.createDataFrame(kept, "word string, term string")
    hit = index.postings(sorted({t for _, t in kept})).select("term", "doc_id").join(F.broadcast(pairs), "term").select("word", "doc_id").distinct()
    return hit.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("doc_id")


def fuzzy_search(index: Index, query: str, min_results: int = 5, config: FuzzyConfig | None = None, legacy_reset: bool = False) -> tuple[DataFrame, bool]:
    """Exact results if there are enough, else fuzzy ones; and which it was."""
    exact = S.search(index, query)
    if min_results <= 0 or exact.limit(min_results).count() >= min_results:
        return exact, False
    return fuzzy_matches(index, query, config, legacy_reset), True
