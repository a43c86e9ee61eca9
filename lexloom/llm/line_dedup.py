"""Op 6: drop multi-line chunks that stand elsewhere, byte for byte.

A rolling hash over the hashes of ``WIDTH`` neighbouring lines cuts each text in
chunks: a line ends a chunk where the rolling hash is 0 modulo ``DIVISOR``, so
boundaries depend on content and come back in step after lines are inserted or
lost.  Chunks of two lines or more are counted over the whole table by a 128-bit
key; those that occur again are fetched, compared byte by byte, and all but the
first (smallest id, then first line) are removed.

With ``whole_runs`` every window of ``min_lines`` neighbouring lines is a chunk of
its own, so a repeated run is removed to its full length wherever boundaries
would lie: a line goes if a window over it stands earlier.  The first place of a
line always stays, and windows that overlap their own first place don't count.

Counts and comparisons are aggregates with map-side partials, so a chunk that a
third of all rows hold is never gathered.

Cases: null texts stay null and empty ones empty; a text of one line or chunks
of one line are never touched; texts whose key agrees but whose bytes differ are
compared within equal bytes only; rows repeated with one id and text count as one
document (both keep or lose the same lines, and never each other's); rows of one
id and different texts are different documents; null ids come last; ties (equal
texts of different ids) keep the smaller id's lines; further columns pass through,
except those named like an output column, which are replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import common as C
from lexloom.llm import textnp as X

WIDTH, DIVISOR, MIN_LINES = 2, 4, 2
NEW = ["n_lines", "n_removed", "spans"]
_ROLL = X.U64(0x9E3779B97F4A7C15)


def lines(off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the newline) of all lines, and each row's first."""
    n = len(off) - 1
    breaks = np.flatnonzero(buf[: len(buf) - 8] == 10)
    row = np.searchsorted(off, breaks, "right") - 1
    first = np.r_[0, np.cumsum(np.bincount(row, minlength=n) + 1)]
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    at = np.arange(len(breaks)) + row  # the line that each newline ends
    starts[first[:-1]], ends[first[1:] - 1] = off[:-1], off[1:]
    ends[at], starts[at + 1] = breaks, breaks + 1
    return starts, ends, first


def chunk_table(off: np.ndarray, buf: np.ndarray, width: int = WIDTH, divisor: int = DIVISOR):
    """Row, first line, line count, byte start and end, and two hashes of each chunk."""
    starts, ends, first = lines(off, buf)
    n = len(off) - 1
    rows = np.repeat(np.arange(n), np.diff(first))
    h = X.hash_spans(buf, starts, ends)
    inside = np.arange(len(rows)) - first[rows]
    roll = h.copy()
    for k in range(1, width):
        # lines before the row's first count as zero: only content decides
        before = np.r_[np.zeros(k, X.U64), h[:-k]] if len(h) > k else np.zeros(len(h), X.U64)
        power = X.U64(pow(int(_ROLL), k, 1 << 64))
        roll += np.where(inside >= k, before, X.U64(0)) * power
    closes = X.mix(roll) % X.U64(divisor) == 0
    closes[first[1:] - 1] = True
    last = np.flatnonzero(closes)
    begin = np.r_[0, last[:-1] + 1] if len(last) else last
    seen = np.arange(len(h)) - np.repeat(begin, last - begin + 1)
    mixed = X.mix(h + seen.astype(X.U64) * X.U64(0xD1B54A32D192ED03))
    h1 = np.add.reduceat(mixed, begin) if len(begin) else mixed
    h2 = np.bitwise_xor.reduceat(X.mix(mixed + _ROLL), begin) if len(begin) else mixed
    return rows[begin], inside[begin], last - begin + 1, starts[begin], ends[last], h1, h2


def window_table(off: np.ndarray, buf: np.ndarray, size: int = MIN_LINES):
    """Like ``chunk_table``, for every ``size`` neighbouring lines of a row."""
    starts, ends, first = lines(off, buf)
    at, rows = X.window_starts(first, size)
    h = X.hash_spans(buf, starts, ends)
    h1, h2 = np.zeros(len(at), X.U64), np.zeros(len(at), X.U64)
    for k in range(size):
        mixed = X.mix(h[at + k] + X.U64(k * 0xD1B54A32D192ED03 & (2**64 - 1)))
        h1, h2 = h1 + mixed, h2 ^ X.mix(mixed + _ROLL)
    return rows, at - first[rows], np.full(len(at), size), starts[at], ends[at + size - 1], h1, h2


def chunks(keyed: DataFrame, width: int = WIDTH, divisor: int = DIVISOR, min_lines: int = MIN_LINES, whole_runs: bool = False) -> DataFrame:
    """``h1, h2, d, t, line, n, lo, hi``: each chunk of ``min_lines`` lines or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, t = np.asarray(b.column(0)), np.asarray(b.column(1))
            for lo, _, off, buf in X.chunks(b.column(2)):
                row, line, n, start, end, h1, h2 = window_table(off, buf, min_lines) if whole_runs else chunk_table(off, buf, width, divisor)
                k = np.flatnonzero(n >= min_lines)
                row, base = row[k], off[row[k]]
                yield pa.record_batch({
                    "h1": pa.array(h1[k].view(np.int64)), "h2": pa.array(h2[k].view(np.int64)), "d": pa.array(d[lo + row]), "t": pa.array(t[lo + row]),
                    "line": pa.array(line[k].astype(np.int32)), "n": pa.array(n[k].astype(np.int32)),
                    "lo": pa.array(start[k] - base), "hi": pa.array(end[k] - base)})

    return keyed.mapInArrow(run, "h1 long, h2 long, d long, t long, line int, n int, lo long, hi long")


def repeated(keyed: DataFrame, width: int = WIDTH, divisor: int = DIVISOR, min_lines: int = MIN_LINES, whole_runs: bool = False) -> DataFrame:
    """``d, t, line, n, lo, hi`` of chunks that stand earlier, byte for byte."""
    found = C.materialize(chunks(keyed, width, divisor, min_lines, whole_runs).withColumn("k", F.struct("h1", "h2")).drop("h1", "h2"), "chunks")
    often = C.materialize(found.groupBy("k").agg(F.count("*").alias("w")).where("w >= 2"), "often")
    again = C.hot_join(found, often, "k", "w", "inner").dropDuplicates(["k", "d", "t", "line"])
    spots = again.groupBy("d", "t").agg(F.collect_list(F.struct("k", "line", "n", "lo", "hi")).alias("spots"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots = b.column(3)
            flat, size = spots.flatten(), np.asarray(spots.value_lengths())
            row = np.repeat(np.arange(b.num_rows), size)
            raw = b.column(2).cast(pa.binary()).to_pylist()
            lo, hi = flat.field("lo").to_pylist(), flat.field("hi").to_pylist()
            yield pa.record_batch({
                "k": flat.field("k"), "bytes": pa.array([raw[r][x:y] for r, x, y in zip(row.tolist(), lo, hi)], pa.binary()),
                "d": b.column(0).take(pa.array(row)), "t": b.column(1).take(pa.array(row)),
                **{c: flat.field(c) for c in ("line", "n", "lo", "hi")}})

    # rows repeated with id and text give equal places, which the comparison folds
    fetched = C.materialize(
        keyed.join(spots, ["d", "t"]).select("d", "t", "text", "spots")
        .mapInArrow(cut, "k struct<h1:long,h2:long>, bytes binary, d long, t long, line int, n int, lo long, hi long"), "fetched")
    place = F.struct("d", "t", "line")
    first = F.col("keep")
    # not the first place, and clear of it
    later = (place != first) & ~((F.col("d") == first["d"]) & (F.col("t") == first["t"]) & (F.col("line") < first["line"] + F.col("n")))
    # equal bytes: all texts of a key agree if the least is the greatest
    same = fetched.groupBy("k").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.min(place).alias("keep"), F.count("*").alias("w"))
    same = C.materialize(same.select("k", (F.col("least") == F.col("most")).alias("same"), "keep", "w"), "compared")
    joined = C.hot_join(fetched.drop("bytes"), same.where("same").drop("same"), "k", "w", "inner")
    out = joined.where(later).select("d", "t", "line", "n", "lo", "hi")
    if same.where("not same").limit(1).count():
        # keys that collided: compare inside equal bytes
        odd = C.hot_join(fetched, same.where("not same").select("k", "w"), "k", "w", "inner").withColumn("kb", F.struct("k", "bytes"))
        exact = C.materialize(odd.groupBy("kb").agg(F.min(place).alias("keep"), F.count("*").alias("w")), "exact")
        rest = C.hot_join(odd, exact, "kb", "w", "inner").where(later)
        out = out.unionByName(rest.select("d", "t", "line", "n", "lo", "hi"))
    return out


def merged(marks: list[dict]) -> list[dict]:
    """Sorted spans, those that overlap as one."""
    out: list[dict] = []
    for m in marks:
        if out and m["line"] < out[-1]["line"] + out[-1]["n"]:
            out[-1] |= {"n": m["line"] + m["n"] - out[-1]["line"], "hi": m["hi"]}
        else:
            out.append(dict(m))
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, divisor: int = DIVISOR, min_lines: int = MIN_LINES,
          whole_runs: bool = False) -> DataFrame:
    """Documents with ``text`` cut, ``n_lines`` before, ``n_removed`` and ``spans``.

    Spans are the removed ``(line, n)``.  Kept lines stay joined by newlines.
    """
    C.check_columns(docs, doc_id, text)
    new = NEW
    docs = C.without(docs, new)
    # one struct holds all input columns, so none can clash with those of this operator
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(text).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    # a chunk of two lines holds a newline
    able = F.contains("text", F.lit("\n"))
    spots = repeated(keyed.where(able).select("d", "t", "text"), width, divisor, min_lines, whole_runs).groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("line", "n", "lo", "hi"))).alias("spots"))
    joined = keyed.where(able).join(spots, ["d", "t"], "left").select("row", "spots")
    rest = keyed.where(~able).select("row", F.lit(None).cast(joined.schema["spots"].dataType).alias("spots"))
    every = joined.unionByName(rest).select("row.*", F.col("spots").alias(C.fresh(docs, "spots")[0]))
    at = docs.columns.index(text)
    full = T.StructType([*docs.schema.fields, *C.schema("n_lines long, n_removed long, spans array<struct<line:int,n:int>>").fields])
    span = pa.list_(pa.struct([("line", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.columns
            spots = own.pop().to_pylist()
            raw = own[at].to_pylist()
            count, gone, cuts = [], [], []
            for i, marks in enumerate(spots):
                x = raw[i]
                marks = merged(marks or [])
                count.append(0 if x is None else x.count("\n") + 1)
                gone.append(sum(m["n"] for m in marks))
                cuts.append([{"line": m["line"], "n": m["n"]} for m in marks])
                if marks:
                    data = x.encode("utf-8", "surrogatepass")
                    keep, p = [], 0
                    for m in marks:
                        if m["lo"] > p:
                            keep.append(data[p : m["lo"] - 1])
                        p = m["hi"] + 1
                    if p <= len(data):
                        keep.append(data[p:])
                    raw[i] = b"\n".join(keep).decode("utf-8", "surrogatepass")
            own[at] = pa.array(raw, own[at].type)
            yield pa.RecordBatch.from_arrays([*own, pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, span)], names=[*b.schema.names[:-1], *new])

    return every.mapInArrow(run, full)
