"""Immutable results of searches: a lazy set of ids with its query text."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import search as S


class ResultHandle:
    """Ids in ascending order, without scores.

    ``frame`` is the distributed form; lists and arrays are for small results.
    """

    def __init__(self, frame: DataFrame, query: str = "", elapsed_ns: int = 0, fuzzy_used: bool = False):
        self.frame = frame.select("doc_id")
        self._query, self.elapsed_ns, self.fuzzy_used = query, elapsed_ns, fuzzy_used
        self._hits: int | None = None

    def query(self) -> str:
        return self._query

    def elapsed_ms(self) -> float:
        return self.elapsed_ns / 1e6

    def elapsed_us(self) -> float:
        return self.elapsed_ns / 1e3

    @property
    def total_hits(self) -> int:
        if self._hits is None:
            self._hits = self.frame.count()
        return self._hits

    def __len__(self) -> int:
        return self.total_hits

    def is_empty(self) -> bool:
        return self.frame.isEmpty() if self._hits is None else self._hits == 0

    def contains(self, doc_id: int) -> bool:
        return not self.frame.where(F.col("doc_id") == int(doc_id)).isEmpty()

    __contains__ = contains

    def top_frame(self, n: int = 100) -> DataFrame:
        return self.frame.orderBy("doc_id").limit(n)

    def top(self, n: int = 100) -> list[int]:
        return [r["doc_id"] for r in self.top_frame(n).collect()]

    def page_frame(self, offset: int, limit: int) -> DataFrame:
        return self.frame.orderBy("doc_id").offset(offset).limit(limit)

    def page(self, offset: int, limit: int) -> list[int]:
        return [r["doc_id"] for r in self.page_frame(offset, limit).collect()]

    def __iter__(self) -> Iterator[int]:
        return (r["doc_id"] for r in self.frame.orderBy("doc_id").toLocalIterator())

    iter = __iter__

    def to_list(self) -> list[int]:
        return list(self)

    def to_numpy(self) -> np.ndarray:
        return np.array(self.to_list(), np.uint64)

    def _derive(self, make, text: str, fuzzy: bool) -> ResultHandle:
        began = time.perf_counter_ns()
        return ResultHandle(make(), text, time.perf_counter_ns() - began, fuzzy)

    def intersect(self, other: ResultHandle) -> ResultHandle:
        return self._derive(lambda: self.frame.join(other.frame, "doc_id", "left_semi"), f"({self._query}) AND ({other._query})", self.fuzzy_used or other.fuzzy_used)

    def union(self, other: ResultHandle) -> ResultHandle:
        return self._derive(lambda: self.frame.unionByName(other.frame).distinct(), f"({self._query}) OR ({other._query})", self.fuzzy_used or other.fuzzy_used)

    def difference(self, other: ResultHandle) -> ResultHandle:
        return self._derive(lambda: self.frame.join(other.frame, "doc_id", "left_anti"), f"({self._query}) NOT ({other._query})", self.fuzzy_used)

    def filter_by_ids(self, ids) -> ResultHandle:
        return self._derive(lambda: S.filter_by_ids(self.frame, ids), f"{self._query} [filtered]", self.fuzzy_used)

    def exclude_ids(self, ids) -> ResultHandle:
        return self._derive(lambda: S.exclude_ids(self.frame, ids), f"{self._query} [excluded]", self.fuzzy_used)

    def __repr__(self) -> str:
        return f"ResultHandle(hits={self.total_hits}, query={self._query!r}, elapsed={self.elapsed_ms():.3f}ms)"
