"""Facade: one object for ingest, search, ranking, mutation and maintenance.

Single documents are analyzed on the driver and buffered; lists of many become
DataFrames, and bulk sources stay DataFrames.  Every write gets a sequence number,
and of all writes to a document the latest counts.  ``flush`` commits the buffer to
the store, by itself once ``flush_bytes`` are buffered.  Until then single documents
and lists stand in the store's log, from which the next engine on that path takes
them up again; frames (``add_frame``) are read from their source at the flush and are
not logged.  A path has one writing engine at a time.
"""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import EngineConfig, FuzzyConfig
from lexloom.functions import analyzer as A
from lexloom.operators import fuzzy, index as I, rank
from lexloom.operators import search as S
from lexloom.operators.idset import MAX_ID
from lexloom.operators.result import ResultHandle
from lexloom.sources import importers, store as ST


#: Lists of so many documents are analyzed by Spark instead of on the driver.
BULK_ROWS = 1_000


class SearchEngine:
    """Full-text engine on Spark; see the module's text for its write semantics."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.store = ST.Store(spark, self.config.path, self.config.drop_if_exists) if self.config.path else None
        self._lock = threading.RLock()
        self._seq = self.store.manifest.last_seq if self.store else 0
        self._flushing = threading.RLock()  # one flush or compaction at a time; searches don't wait for it
        self._rows: list[tuple] = []  # single operations
        self._frames: list[DataFrame] = []  # bulk operations
        self._logged: list[str] = []  # their batches in the log
        self._bytes = 0
        self._deleted: set[int] = set()
        self._results: OrderedDict[tuple, ResultHandle] = OrderedDict()
        self._cache_on, self._preloaded = True, False
        self._index: I.Index | None = None
        self._warm: list[DataFrame] = []
        self._pool: ThreadPoolExecutor | None = None
        self._pending: Future | None = None
        self._counts = {"search_count": 0, "fuzzy_search_count": 0, "cache_hits": 0, "cache_misses": 0}
        for name, batch in self.store.pending() if self.store else []:
            self._logged.append(name)
            if isinstance(batch, DataFrame):
                self._frames.append(self._analyzed(batch, self._next()))
            else:
                self._seq = max(self._seq, *(r[0] for r in batch))
                self._hold(batch)

    # ---- writes

    def _next(self) -> int:
        self._seq += 1
        return self._seq

    def _changed(self) -> None:
        self._index = None
        self._results.clear()

    def refresh(self) -> None:
        """Forget what was resolved before a commit from elsewhere."""
        with self._lock:
            if self.store:
                self.store.reload()
                self._seq = max(self._seq, self.store.manifest.last_seq)
            self._changed()

    def _hold(self, rows: list[tuple]) -> None:
        for seq, op, doc_id, *_ in rows:
            (self._deleted.add if op == ST.DELETE else self._deleted.discard)(doc_id)
        self._rows.extend(rows)
        self._bytes += sum(sum(map(len, r[3])) for r in rows)

    def _write(self, ops: list[tuple[str, int, list[str | None]]]) -> None:
        """Log and buffer single operations ``(op, id, values)``."""
        for _, doc_id, _ in ops:
            if not 0 <= int(doc_id) <= MAX_ID:
                raise ValueError("document ids must be from 0 to 2^63 - 1")
        c = self.config
        read = [(op, int(d), *(A.py_analyze(v, c.min_term_length, c.max_cjk_length) if op == ST.UPSERT else ([], [], 0))) for op, d, v in ops]
        with self._lock:
            rows = [(self._next(), *r) for r in read]
            if self.store and c.wal and rows:
                self._logged.append(self.store.log(rows[0][0], rows))
            self._hold(rows)
            self._changed()
        if self.store and self._bytes >= c.flush_bytes:
            self.flush()

    def _bulk(self, doc_ids: list[int], columns: list[list[str | None]]) -> None:
        """Many documents at once: an Arrow table, analyzed by Spark."""
        last = {int(d): i for i, d in enumerate(doc_ids)}  # of documents given twice the last counts
        if last and not (0 <= min(last) and max(last) <= MAX_ID):
            raise ValueError("document ids must be from 0 to 2^63 - 1")
        at = sorted(last.values())
        text = lambda v: None if v is None else str(v)
        table = pa.table({"doc_id": pa.array([int(doc_ids[i]) for i in at], pa.int64()), **{f"text_{k}": pa.array([text(c[i]) for i in at], pa.string()) for k, c in enumerate(columns)}})
        with self._lock:
            seq, frame = self._next(), self.spark.createDataFrame(table)
            if self.store and self.config.wal:
                name, frame = self.store.log_frame(seq, frame)
                self._logged.append(name)
            self._frames.append(self._analyzed(frame, seq))
            self._deleted -= set(last)
            self._bytes += table.nbytes
            self._changed()
        if self.store and self._bytes >= self.config.flush_bytes:
            self.flush()

    def _analyzed(self, ready: DataFrame, seq: int) -> DataFrame:
        """Operations of a table of ``doc_id`` and texts."""
        analyzed = A.analyze(ready, [c for c in ready.columns if c != "doc_id"], "doc_id", self.config.min_term_length, self.config.max_cjk_length)
        return analyzed.select(F.lit(seq).cast("long").alias("seq"), F.lit(ST.UPSERT).alias("op"), "doc_id", "tokens", "grams", "dl")

    def add_document(self, doc_id: int, fields: Mapping[str, str]) -> None:
        """Fields join by a space, in insertion order."""
        self._write([(ST.UPSERT, doc_id, [" ".join("" if v is None else str(v) for v in fields.values())])])

    update_document = add_document

    def add_documents(self, docs: Iterable[tuple[int, Mapping[str, str]]]) -> int:
        """Fields keep apart: phrases don't cross them."""
        docs = [(d, list(fields.values())) for d, fields in docs]
        if len(docs) < BULK_ROWS:
            self._write([(ST.UPSERT, d, [None if v is None else str(v) for v in values]) for d, values in docs])
        else:
            width = max(len(v) for _, v in docs)
            self._bulk([d for d, _ in docs], [[v[k] if k < len(v) else None for _, v in docs] for k in range(width)])
        return len(docs)

    def add_documents_columnar(self, doc_ids: list[int], columns: list[tuple[str, list[str]]]) -> int:
        if any(len(c) != len(doc_ids) for _, c in columns):
            raise ValueError("all columns must be as long as doc_ids")
        if len(doc_ids) < BULK_ROWS or not columns:
            self._write([(ST.UPSERT, d, [None if c[i] is None else str(c[i]) for _, c in columns]) for i, d in enumerate(doc_ids)])
        else:
            self._bulk(doc_ids, [c for _, c in columns])
        return len(doc_ids)

    def add_documents_texts(self, doc_ids: list[int], texts: list[str]) -> int:
        return self.add_documents_columnar(doc_ids, [("text", texts)])

    def add_documents_arrow_str(self, doc_ids, columns) -> int:
        """The same for Arrow arrays, of any length without a loop over rows."""
        columns = [(n, c) for n, c in columns]
        if any(len(c) != len(doc_ids) for _, c in columns):
            raise ValueError("all columns must be as long as doc_ids")
        table = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), **{f"text_{k}": pa.array(c, pa.string()) for k, (_, c) in enumerate(columns)}})
        if not len(table):
            return 0
        if pc.min(table["doc_id"]).as_py() < 0:
            raise ValueError("document ids must be from 0 to 2^63 - 1")
        with self._lock:
            seq, frame = self._next(), self.spark.createDataFrame(table)
            if self.store and self.config.wal:
                name, frame = self.store.log_frame(seq, frame)
                self._logged.append(name)
            self._frames.append(self._analyzed(frame, seq))
            self._bytes += table.nbytes
            self._changed()
        if self.store and self._bytes >= self.config.flush_bytes:
            self.flush()
        return len(table)

    def add_documents_arrow_texts(self, doc_ids, texts) -> int:
        return self.add_documents_arrow_str(doc_ids, [("text", texts)])

    def add_frame(self, docs: DataFrame, text_columns: list[str] | None = None, id_column: str = "doc_id") -> None:
        """Bulk ingest of a DataFrame; of rows of one id the last by content hash counts."""
        ready, names = importers.prepare(docs, id_column, text_columns)
        if not names:
            ready, names = ready.withColumn("text_0", F.lit("")), ["text_0"]
        with self._lock:
            self._frames.append(self._analyzed(ready, self._next()))
            self._changed()

    def _import(self, frame: DataFrame, id_column: str, text_columns: list[str] | None) -> int:
        n = frame.count()
        if n:
            self.add_frame(frame, text_columns, id_column)
            self.flush()
        return n

    def from_pandas(self, frame, id_column: str = "id", text_columns: list[str] | None = None) -> int:
        return self._import(importers.from_pandas(self.spark, frame), id_column, text_columns)

    def from_polars(self, frame, id_column: str = "id", text_columns: list[str] | None = None) -> int:
        return self._import(importers.from_polars(self.spark, frame), id_column, text_columns)

    def from_arrow(self, table, id_column: str = "id", text_columns: list[str] | None = None) -> int:
        return self._import(importers.from_arrow(self.spark, table), id_column, text_columns)

    def from_parquet(self, path: str, id_column: str = "id", text_columns: list[str] | None = None) -> int:
        return self._import(importers.from_parquet(self.spark, path), id_column, text_columns)

    def from_csv(self, path: str, id_column: str = "id", text_columns: list[str] | None = None, **options) -> int:
        return self._import(importers.from_csv(self.spark, path, **options), id_column, text_columns)

    def from_json(self, path: str, id_column: str = "id", text_columns: list[str] | None = None, lines: bool = False, **options) -> int:
        return self._import(importers.from_json(self.spark, path, lines, **options), id_column, text_columns)

    def from_dict(self, rows: list[Mapping], id_column: str = "id", text_columns: list[str] | None = None) -> int:
        return self._import(importers.from_rows(self.spark, rows), id_column, text_columns) if rows else 0

    def remove_document(self, doc_id: int) -> None:
        self._write([(ST.DELETE, doc_id, [])])

    def remove_documents(self, doc_ids: Iterable[int]) -> None:
        self._write([(ST.DELETE, d, []) for d in doc_ids])

    def remove_frame(self, doc_ids: DataFrame) -> None:
        """Bulk delete: the first column holds ids."""
        ids = doc_ids.select(F.col(doc_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        with self._lock:
            none = F.array().cast("array<string>")
            self._frames.append(ids.select(F.lit(self._next()).cast("long").alias("seq"), F.lit(ST.DELETE).alias("op"), "doc_id", none.alias("tokens"), none.alias("grams"), F.lit(0).alias("dl")))
            self._changed()

    # ---- the resolved index

    def _buffered(self, rows: list[tuple] | None = None, frames: list[DataFrame] | None = None) -> DataFrame | None:
        """One operation a document: the buffer's latest.

        Only ids are aggregated to see which documents were written twice; token
        arrays of all others never move.
        """
        rows, frames = self._rows if rows is None else rows, self._frames if frames is None else frames
        last = {r[2]: r for r in rows}
        parts = [*frames, *([self.spark.createDataFrame(list(last.values()), ST.OPS)] if rows else [])]
        if not parts:
            return None
        every = reduce(DataFrame.unionByName, parts)
        if not frames:
            return every
        twice = every.groupBy("doc_id").count().where("count > 1").select("doc_id")
        if twice.isEmpty():
            return every
        body = F.struct("seq", "op", "tokens", "grams", "dl")
        # ties inside one bulk frame: the greatest hash
        resolved = every.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(body, F.struct("seq", F.xxhash64("tokens"))).alias("b")).select("b.seq", "b.op", "doc_id", "b.tokens", "b.grams", "b.dl")
        return every.join(twice, "doc_id", "left_anti").select(resolved.columns).unionByName(resolved)

    def index(self) -> I.Index:
        """Live documents and, where all is stored, their stored postings."""
        with self._lock:
            if self._index is None:
                buffered = self._buffered()
                c = self.config
                new = None if buffered is None else buffered.where(F.col("op") == ST.UPSERT).drop("op")
                if self.store and self.store.manifest.segments:
                    docs, posted, terms = self.store.live_documents(), self.store.live_postings(), self.store.terms()
                    manifest = self.store.manifest

                    def computed(*columns: Column) -> DataFrame:
                        rows = self.store.at(manifest).live_documents(*columns).drop("seq")
                        return rows if buffered is None else rows.join(buffered.select("doc_id"), "doc_id", "left_anti").unionByName(new.select("doc_id", *columns))

                    if buffered is not None:
                        ids = buffered.select("doc_id")  # one row a document: they hide what is stored of it
                        docs = docs.join(ids, "doc_id", "left_anti").unionByName(new)
                        posted = posted.join(ids, "doc_id", "left_anti").unionByName(I.postings(new).select("term", "doc_id", "seq", "tf", "dl"))
                        terms = None
                    self._index = I.Index(docs.drop("seq"), posted.drop("seq"), c.min_term_length, c.max_cjk_length, stored_terms=terms, computed=computed)
                else:
                    docs = self.spark.createDataFrame([], ST.OPS).drop("op") if new is None else new
                    self._index = I.Index(docs.drop("seq"), None, c.min_term_length, c.max_cjk_length)
            return self._index

    # ---- searches

    def _run(self, kind: str, query: str, make) -> ResultHandle:
        key = (kind, query)
        with self._lock:
            if self._cache_on and key in self._results:
                self._counts["cache_hits"] += 1
                self._results.move_to_end(key)
                return self._results[key]
            self._counts["cache_misses"] += 1
        began = time.perf_counter_ns()
        frame, used = make()
        result = ResultHandle(frame, query, time.perf_counter_ns() - began, used)
        with self._lock:
            if self._cache_on:
                self._results[key] = result
                while len(self._results) > max(1, self.config.cache_size):
                    self._results.popitem(last=False)
        return result

    def search(self, query: str) -> ResultHandle:
        self._counts["search_count"] += 1
        return self._run("exact", query, lambda: (S.search(self.index(), query), False))

    def search_and(self, queries: list[str]) -> ResultHandle:
        return ResultHandle(S.search_and(self.index(), queries), " AND ".join(queries))

    def search_or(self, queries: list[str]) -> ResultHandle:
        return ResultHandle(S.search_or(self.index(), queries), " OR ".join(queries))

    def search_batch(self, queries: list[str]) -> list[ResultHandle]:
        """Results in list order, out of one distributed job."""
        if not queries:
            return []
        found = S.search_batch(self.index(), queries).cache()  # all results share it until clear_lru_cache
        self._warm.append(found)
        return [ResultHandle(found.where(F.col("query_id") == i).select("doc_id"), q) for i, q in enumerate(queries)]

    def fuzzy_search(self, query: str, min_results: int = 5) -> ResultHandle:
        self._counts["fuzzy_search_count"] += 1
        return self._run(f"fuzzy {min_results}", query, lambda: fuzzy.fuzzy_search(self.index(), query, min_results, self.config.fuzzy))

    def _need_tokens(self) -> None:
        if not self.config.track_doc_terms:
            raise RuntimeError("ranking needs track_doc_terms=True")

    def search_ranked(self, query: str, limit: int = 100) -> list[tuple[int, float]]:
        """(id, score) pairs, best first."""
        self._need_tokens()
        if limit <= 0:
            return []
        return [(r["doc_id"], r["score"]) for r in rank.search_ranked(self.index(), query, limit).orderBy("rank").collect()]

    def search_scored(self, query: str) -> DataFrame:
        """All matches with their scores, as a DataFrame."""
        self._need_tokens()
        return rank.search_scored(self.index(), query)

    def search_top_n(self, query: str, n: int = 10) -> list[int]:
        return [d for d, _ in self.search_ranked(query, n)]

    def filter_by_ids(self, result: ResultHandle, ids) -> ResultHandle:
        return result.filter_by_ids(ids)

    def exclude_ids(self, result: ResultHandle, ids) -> ResultHandle:
        return result.exclude_ids(ids)

    # ---- persistence

    def flush(self) -> int:
        """Commit the buffer; the number of distinct terms in it (0 in memory).

        Searches and writes go on meanwhile: the buffer stays until its segment is listed.
        """
        with self._flushing:
            with self._lock:
                if self.store is None:
                    self._deleted.clear()
                    return 0
                rows, frames, logged, seq, size = list(self._rows), list(self._frames), list(self._logged), self._seq, self._bytes
            buffered = self._buffered(rows, frames)
            if buffered is None:
                return 0
            name = self.store.append(buffered, seq, logged)
            with self._lock:
                del self._rows[: len(rows)], self._frames[: len(frames)], self._logged[: len(logged)]
                self._seq, self._bytes = max(self._seq, self.store.manifest.last_seq), self._bytes - size
                self._deleted.clear()
                waiting, self._rows = self._rows, []
                self._bytes -= sum(sum(map(len, r[3])) for r in waiting)
                self._hold(waiting)
                self._changed()
            return self.store.term_rows(name)

    def flush_async(self) -> None:
        """Flush in a thread; searches see the buffered documents throughout."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(1)
        self.wait_flush()
        self._pending = self._pool.submit(self.flush)

    def wait_flush(self) -> int:
        pending, self._pending = self._pending, None
        return pending.result() if pending else 0

    save = flush

    def load(self) -> None:
        self.refresh()

    def preload(self) -> int:
        """Cache the postings; the term count at the first call, then 0."""
        if self._preloaded:
            return 0
        self._preloaded = True
        index = self.index()
        if index.stored is not None:
            index.stored = index.stored.cache()
        return self.term_count()

    def compact(self) -> None:
        """Rewrite live documents as one segment (nothing to do in memory)."""
        if self.store is None:
            return
        with self._flushing:
            self.flush()
            self.store.compact()
            with self._lock:
                self._changed()

    def close(self) -> None:
        self.wait_flush()
        if self._pool:
            self._pool.shutdown()
            self._pool = None

    # ---- settings, caches, statistics

    def set_fuzzy_config(self, threshold: float = 0.7, max_distance: int = 2, max_candidates: int = 20) -> None:
        self.config = replace(self.config, fuzzy=FuzzyConfig(threshold, max_distance, max_candidates))
        self._results.clear()

    def get_fuzzy_config(self) -> dict[str, float]:
        f = self.config.fuzzy
        return {"threshold": float(f.threshold), "max_distance": float(f.max_distance), "max_candidates": float(f.max_candidates)}

    def clear_cache(self) -> None:
        self._results.clear()

    def set_result_cache_enabled(self, on: bool) -> None:
        self._cache_on = on
        if not on:
            self._results.clear()

    def clear_doc_terms(self) -> None:
        """Tokens are always kept (ranking needs them); only caches go."""
        self._results.clear()

    def doc_terms_size(self) -> int:
        return self.index().doc_tokens.count()

    def warmup_terms(self, terms: list[str]) -> int:
        """Cache the postings of some terms; how many of them there are."""
        if self.store is None or not self.config.lazy_load or not terms:
            return 0
        hot = self.index().postings(list(terms)).cache()
        self._warm.append(hot)
        return hot.select("term").distinct().count()

    def clear_lru_cache(self) -> None:
        for f in self._warm:
            f.unpersist()
        self._warm = []

    def cache_stats(self) -> tuple[int, int, int]:
        """(hits, misses, entries)."""
        return self._counts["cache_hits"], self._counts["cache_misses"], len(self._results)

    def cache_hit_rate(self) -> float:
        hits, misses, _ = self.cache_stats()
        return hits / (hits + misses) if hits + misses else 0.0

    def all_terms(self) -> DataFrame:
        return self.index().terms()

    def term_count(self) -> int:
        """Distinct live terms."""
        return self.all_terms().count()

    def buffer_size(self) -> int:
        """Distinct terms that wait for a flush."""
        buffered = self._buffered()
        return 0 if buffered is None else I.postings(buffered.drop("op", "seq")).select("term").distinct().count()

    def memtable_size(self) -> int:
        """Bytes of the terms that wait for a flush."""
        buffered = self._buffered()
        if buffered is None:
            return 0
        return buffered.select(F.sum(F.octet_length(F.array_join("tokens", " "))).alias("n")).first()["n"] or 0

    def segment_count(self) -> int:
        return len(self.store.manifest.segments) if self.store else 0

    page_count = segment_count

    def deleted_count(self) -> int:
        """Deletes that wait for a flush."""
        return len(self._deleted)

    def is_memory_only(self) -> bool:
        return self.store is None

    def is_lazy_load(self) -> bool:
        return self.store is not None and self.config.lazy_load

    def needs_rebuild(self) -> bool:
        return False

    def wal_size(self) -> int:
        """Bytes of the log of writes that wait for a commit."""
        return self.store.log_size() if self.store else 0

    def wal_pending_batches(self) -> int:
        return len(self._logged)

    def is_wal_enabled(self) -> bool:
        return self.store is not None and self.config.wal

    def stats(self) -> dict[str, float]:
        n, total = self.index().corpus()
        hits, misses, entries = self.cache_stats()
        out = {
            **{k: float(v) for k, v in self._counts.items()}, "cache_entries": float(entries), "cache_hit_rate": self.cache_hit_rate(),
            "buffer_batches": float(len(self._frames) + bool(self._rows)), "deleted_count": float(self.deleted_count()), "doc_count": float(n), "total_tokens": float(total),
            "term_count": float(self.term_count()), "memory_only": float(self.is_memory_only()), "track_doc_terms": float(self.config.track_doc_terms),
        }
        if self.store:
            out |= {"segment_count": float(self.segment_count()), "version": float(self.store.manifest.version), "wal_size": float(self.wal_size()), "lazy_load": float(self.is_lazy_load())}
        return out

    def __repr__(self) -> str:
        if self.store is None:
            return f"SearchEngine(memory_only=True, buffered={len(self._frames) + bool(self._rows)})"
        return f"SearchEngine(path={self.store.path!r}, segments={self.segment_count()}, lazy={self.is_lazy_load()})"


def create_engine(spark: SparkSession, index_file: str = "", max_chinese_length: int = 4, min_term_length: int = 2, fuzzy_threshold: float = 0.7, fuzzy_max_distance: int = 2,
                  track_doc_terms: bool = True, drop_if_exists: bool = False, lazy_load: bool = True, cache_size: int = 10_000) -> SearchEngine:
    """Open or create an engine; an empty path keeps it in memory."""
    fuzz = FuzzyConfig(fuzzy_threshold, fuzzy_max_distance)
    return SearchEngine(spark, EngineConfig(index_file, max_chinese_length, min_term_length, fuzz, track_doc_terms, drop_if_exists, lazy_load, cache_size))
