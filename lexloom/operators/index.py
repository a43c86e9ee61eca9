"""The inverted index as DataFrames.

``doc_tokens(doc_id, tokens, grams, dl)`` has one row a document, and
``postings(term, doc_id, tf, dl)`` one row a (term, document).  Carrying ``dl``
in the postings lets ranking read nothing else.  A filter on ``term`` reaches
the explode of an unstored index before its shuffle, and the pages of a stored one.

Cases: documents without tokens have no postings but count as documents; null
ids are rejected by the importers; rows of one id must have been resolved before
(latest wins, see ``sources.store``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import analyzer as A


def postings(doc_tokens: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Postings of all terms, or of some; grams of CJK runs have tf 0.

    A document is one row, so its tokens are counted inside it: sorted, and cut
    where they change.  Nothing is shuffled.
    """
    carry = [c for c in doc_tokens.columns if c not in ("tokens", "grams")]
    if terms is not None:
        # few kinds of terms: count in the row, no shuffle at all
        kinds = F.array_intersect(F.concat(F.col("tokens"), F.col("grams")), F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>"))
        rows = F.transform(kinds, lambda k: F.struct(k.alias("term"), F.size(F.filter("tokens", lambda t: t == k)).alias("tf")))
        return doc_tokens.select(*carry, F.inline(rows)).select("term", *carry, F.col("tf").cast("int").alias("tf"))
    s, at = F.col("_sorted"), F.col("_at")
    rows = doc_tokens.select(*carry, F.sort_array("tokens").alias("_sorted"), "grams")
    cuts = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*carry, "_sorted", "grams", cuts.alias("_at"))
    counted = F.transform(at, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).cast("int").alias("tf")))
    counted = F.filter(counted, lambda x: x["term"] != A.BOUNDARY)
    also = F.transform(F.array_except("grams", s), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf")))
    return rows.select(*carry, F.inline(F.when(F.size("grams") > 0, F.concat(counted, also)).otherwise(counted))).select("term", *carry, "tf")


#: Tokens that are sorted at once; they bound a worker's memory.
RUN_TOKENS = 2_000_000
RUNS = "term string, doc_id long, seq long, tf int, dl int"


def runs(doc_tokens: DataFrame) -> DataFrame:
    """All postings of ``doc_id, seq, dl, tokens, grams`` in runs sorted by term.

    A task sorts the tokens of some thousand documents after the other in numpy.
    Nothing is shuffled, and nothing is sorted that could outgrow memory and spill.
    """
    return doc_tokens.select("doc_id", "seq", "dl", "tokens", "grams").mapInArrow(_runs, RUNS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, room = [], RUN_TOKENS
    for b in batches:
        ends = np.cumsum(sum(pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tokens", "grams")))
        at, before = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + room, "right")))  # one document at least
            held.append(b.slice(at, to - at))
            room -= int(ends[to - 1]) - before
            at, before = to, int(ends[to - 1])
            if room <= 0 or at < b.num_rows:
                yield from _run(held)
                held, room = [], RUN_TOKENS
    if held:
        yield from _run(held)


def _run(docs: list[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The postings of some documents, sorted by term."""
    lists = {c: pa.concat_arrays([b.column(c) for b in docs]) for c in ("tokens", "grams")}
    n = sum(b.num_rows for b in docs)
    whose = np.concatenate([np.repeat(np.arange(n), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in lists.values()])
    flat = [x.flatten() for x in lists.values()]
    coded = pa.concat_arrays(flat).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)  # by bytes, as Spark sorts
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    key = (place[coded.indices.to_numpy()] * n + whose) * 2
    key[len(flat[0]):] += 1  # grams
    names = coded.dictionary.take(order)
    del coded, flat, lists, whose
    key.sort()
    pairs = key >> 1
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
    tf = np.add.reduceat(1 - (key & 1), first) if len(first) else first
    term, doc = np.divmod(pairs[first], n)
    del key, pairs
    bare = pc.index(names, A.BOUNDARY).as_py()
    if bare >= 0:
        keep = term != bare
        term, doc, tf = term[keep], doc[keep], tf[keep]
    own = {c: pa.concat_arrays([b.column(c) for b in docs]) for c in ("doc_id", "seq", "dl")}
    for i in range(0, len(term), rows):
        d = pa.array(doc[i : i + rows])
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(term[i : i + rows])), own["doc_id"].take(d), own["seq"].take(d), pa.array(tf[i : i + rows].astype(np.int32)), own["dl"].take(d)], ["term", "doc_id", "seq", "tf", "dl"])
    del docs[:], names, own, term, doc, tf
    pa.default_memory_pool().release_unused()


def term_stats(posted: DataFrame) -> DataFrame:
    """``term, df, len``: document frequency and length of each live term."""
    return posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("len", F.char_length("term").cast("int"))


def corpus_stats(doc_tokens: DataFrame) -> DataFrame:
    """One row ``n_docs, total_len``; documents without tokens count."""
    return doc_tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_len"))


@dataclass
class Index:
    """Resolved documents, and (if stored) their postings."""

    doc_tokens: DataFrame
    stored: DataFrame | None = None
    min_term: int = A.MIN_TERM
    max_cjk: int = A.MAX_CJK
    #: analyzes those texts that may hold all given terms (unstored indexes of raw texts)
    narrow: Callable[[list[str]], DataFrame] | None = None
    #: the distinct live terms, where they are stored
    stored_terms: DataFrame | None = None
    #: live documents with columns computed before anything is joined (stored indexes)
    computed: Callable[..., DataFrame] | None = None
    _kept: list[DataFrame] = field(default_factory=list)

    @classmethod
    def build(cls, docs: DataFrame, columns: list[str], doc_id: str = "doc_id", min_term: int = A.MIN_TERM, max_cjk: int = A.MAX_CJK, nfkc: bool = True) -> Index:
        def analyzed(rows: DataFrame) -> DataFrame:
            return A.analyze(rows, columns, doc_id, min_term, max_cjk, nfkc)

        def narrow(terms: list[str]) -> DataFrame:
            # a term that is no substring of any field is no token: texts without it aren't cut in words
            fields = F.array(*[A.normalize(F.coalesce(F.col(c).cast("string"), F.lit("")), nfkc) for c in columns])
            return analyzed(docs.withColumn("__fields", fields).where(reduce(Column.__and__, [F.exists("__fields", lambda f: F.contains(f, F.lit(t))) for t in terms])).drop("__fields"))

        return cls(analyzed(docs), None, min_term, max_cjk, narrow)

    def holding(self, terms: list[str]) -> DataFrame:
        """Documents that hold all terms; analyzed rows."""
        rows = self.narrow(terms) if self.narrow else self.doc_tokens
        held = F.concat("tokens", "grams")
        return rows.where(reduce(Column.__and__, [F.array_contains(held, t) for t in terms]))

    def documents(self, *columns: Column) -> DataFrame:
        """``doc_id`` and named columns of documents' rows; token arrays don't move."""
        return self.computed(*columns) if self.computed else self.doc_tokens.select("doc_id", *columns)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        if self.stored is None:
            return postings(self.doc_tokens, terms)
        return self.stored if terms is None else self.stored.where(F.col("term").isin(terms))

    def terms(self) -> DataFrame:
        """Distinct ``term`` of all live documents."""
        if self.stored_terms is not None:
            return self.stored_terms.select("term").distinct()
        if self.stored is not None:  # a narrower way to the live ones than by their postings
            return self.documents(F.array_distinct(F.concat(F.filter("tokens", lambda t: t != A.BOUNDARY), F.col("grams"))).alias("terms")).select(F.explode("terms").alias("term")).distinct()
        return self.postings().select("term").distinct()

    def keep(self, rows: DataFrame, most: int = 4) -> DataFrame:
        """Persist narrow rows that a query reads twice; older ones are let go (and computed anew if asked for)."""
        self._kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        while len(self._kept) > most:
            self._kept.pop(0).unpersist()
        return rows

    def corpus(self) -> tuple[int, int]:
        r = corpus_stats(self.doc_tokens).first()
        return r["n_docs"], r["total_len"]

    def statistics(self, terms: list[str]) -> tuple[int, int, dict[str, int]]:
        """Documents, tokens, and the document frequency of each term (of a stored index)."""
        found = self.postings(terms).groupBy("term").agg(F.count("*").alias("n")).collect()  # a row a term
        return *self.corpus(), {t: 0 for t in terms} | {r["term"]: r["n"] for r in found}
