"""Op 7: token counts by a two-tier lookup, without any pre-token shuffle.

First a pass over all texts finds frequent units (heavy hitters a partition,
merged); the lengths of the ``table_rows`` most frequent go to the workers as
two sorted arrays, so the broadcast is bounded.  The counting pass looks all
units of a batch up in it; units not found are encoded once and kept in the
worker's bounded cache.  The table and the cache save work only: counts never
depend on them.

Cases: null and empty texts have 0 bytes and 0 tokens; texts are never cut;
repeated rows count alike; an empty table gives an empty result.  Further
columns pass through, except those named like an output column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import common as C
from lexloom.llm import pieces as P
from lexloom.llm import textnp as X

TABLE_ROWS, PER_PARTITION, CACHE_ROWS, LIMIT = 65_536, 8_192, 1_000_000, 4096


def frequent(docs: DataFrame, text: str = "text", per_partition: int = PER_PARTITION, table_rows: int = TABLE_ROWS, lean: bool = False) -> list[tuple[int, str]]:
    """The most frequent units over all texts, as (spaces, word); ``lean`` workers keep no free memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lean:
            X.lean()
        keys, counts, names = np.zeros(0, X.U64), np.zeros(0, np.int64), np.zeros(0, object)
        for b in batches:
            for _, _, off, buf in X.chunks(P.escape(b.column(0))):
                u = P.Units(off, buf)
                h, first, n = np.unique(u.hashes(), return_index=True, return_counts=True)
                top = np.argsort(-n, kind="stable")[:per_partition]
                new = np.array([None, *[u.text(i) for i in first[top]]], dtype=object)[1:]
                both, inverse = np.unique(np.concatenate([keys, h[top]]), return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, inverse, np.concatenate([counts, n[top]]))
                name = np.empty(len(both), object)
                name[inverse] = np.concatenate([names, new])
                best = np.argsort(-total, kind="stable")[: 2 * per_partition]
                keys, counts, names = both[best], total[best], name[best]
        keep = slice(0, per_partition)
        yield pa.record_batch({
            "k": pa.array([x[0] for x in names[keep]], pa.int32()), "w": pa.array([x[1] for x in names[keep]], pa.string()), "n": pa.array(counts[keep], pa.int64())})

    found = docs.select(text).mapInArrow(run, "k int, w string, n long").groupBy("k", "w").agg(F.sum("n").alias("n"))
    return [(r["k"], r["w"]) for r in found.orderBy(F.desc("n"), "k", "w").limit(table_rows).collect()]


def table_of(path: str, units: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unit hashes and their token counts."""
    if not units:
        return np.zeros(0, X.U64), np.zeros(0, np.int32)
    data = [w.encode() for _, w in units]
    ends = np.cumsum([len(d) for d in data])
    buf = np.frombuffer(b"".join(data) + b"\0" * 8, np.uint8)
    h = X.hash_spans(buf, ends - np.array([len(d) for d in data]), ends)
    h = X.mix(h ^ (np.array([k for k, _ in units]).astype(X.U64) * X.U64(0xA24BAED4963EE407)))
    n = np.array([len(x) for x in P.encode_units(path, units)], np.int32)
    order = np.argsort(h)
    return h[order], n[order]


def count(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = LIMIT, table_rows: int = TABLE_ROWS, cache_rows: int = CACHE_ROWS) -> DataFrame:
    """Documents with ``n_bytes, n_tokens, over_limit``."""
    C.check_columns(docs, text)
    path = path or P.model_path()
    new = ["n_bytes", "n_tokens", "over_limit"]
    docs = C.without(docs, new)
    at = docs.columns.index(text)
    table = table_of(path, frequent(docs, text, table_rows=table_rows)) if table_rows else table_of(path, [])
    shared = docs.sparkSession.sparkContext.broadcast(table)  # at most table_rows x 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths = shared.value
        cache: dict[int, int] = {}
        for b in batches:
            tokens = []
            raw = b.column(at)
            for lo, hi, off, buf in X.chunks(P.escape(raw)):
                u = P.Units(off, buf)
                h = u.hashes()
                n = np.zeros(len(h), np.int64)
                miss = np.arange(len(h))
                if len(keys) and len(h):
                    slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[slot] == h
                    n[hit] = lengths[slot[hit]]
                    miss = np.flatnonzero(~hit)
                distinct, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
                known = [cache.get(x) for x in distinct.tolist()]
                fresh = [i for i, x in enumerate(known) if x is None]
                for i, ids in zip(fresh, P.encode_units(path, [u.text(miss[first[i]]) for i in fresh])):
                    known[i] = len(ids)
                if len(cache) + len(fresh) > cache_rows:
                    cache.clear()
                cache.update((int(distinct[i]), known[i]) for i in fresh[:cache_rows])
                if len(miss):
                    n[miss] = np.array(known, np.int64)[inverse]
                rows = hi - lo
                total = np.bincount(u.rows, n, rows) + np.bincount(u.line_rows, minlength=rows)
                if len(u.lone_rows):
                    ks, where = np.unique(u.lone_spaces, return_inverse=True)
                    total += np.bincount(u.lone_rows, np.array([len(P.run_ids(path, int(k))) for k in ks])[where], rows)
                tokens.append(total.astype(np.int64))
            n = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            size = pc.fill_null(pc.binary_length(raw), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, size, pa.array(n), pa.array(n > limit)], names=[*b.schema.names, *new])

    full = T.StructType([*docs.schema.fields, *C.schema("n_bytes long, n_tokens long, over_limit boolean").fields])
    return docs.mapInArrow(run, full)
