"""Op 9: remove every word covered by a 35-word window that occurs twice.

An index of the whole corpus per shard, searched by every document, would cost
documents times shards.  So windows are first told apart by content: a window's
*minimizer* is the 5-word shingle of least hash in it, and equal windows have
equal minimizers at equal places.  The stretch of consecutive windows that one
minimizer occurrence owns is a *segment*.  Minimizers that occur once own no
repeat; equal segments that occur twice or more are repeats as they stand.  Only
segments that share a minimizer but differ go on to FM-index shards, by
minimizer: each shard indexes its segments in a compressed FM-index and streams
them through it by backward search, which reports the stretches of 35 words or
more that occur elsewhere.  Work and disk stay in proportion to the corpus.

A minimizer with more than ``hot`` different segments (a passage that many
documents quote in different surroundings) would make one shard too large; its
windows are counted by hash instead, pre-aggregated map-side, with no cap.

Cases: null and empty texts have no words, nothing is removed and the hash is
that of the empty string; texts shorter than the window are kept whole; repeated
rows are documents of their own, so their long texts count as repeats; null ids
are documents too; windows never cross documents; overlapping repeats (a period)
are repeats; ties don't occur (all places of a repeat go); only id and text are
read, so further columns can't clash; an empty table gives an empty result; texts
are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import common as C
from lexloom.llm import textnp as X
from lexloom.llm.fmindex import FMIndex

WINDOW, SHINGLE = 35, 5
SHARD_SEGMENTS, HOT_SEGMENTS = 8_192, 16_384
_BASE = X.U64(0x9E3779B97F4A7C15)
_INVERSE = X.U64(pow(int(_BASE), -1, 1 << 64))
_PLACE = 28


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW, n: int = SHINGLE):
    """Rows, first windows, window counts, minimizer hashes and segment hashes.

    ``h`` are the word hashes of a chunk, ``first`` its rows' first words.
    """
    starts, rows = X.window_starts(first, window)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(X.U64), z.astype(X.U64)
    gram = X.ngram_hashes(h, n)
    place = np.arange(len(gram), dtype=X.U64)
    least = (gram >> X.U64(_PLACE) << X.U64(_PLACE)) | place  # ties: leftmost
    width, span = window - n + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    chosen = (least[starts] & X.U64((1 << _PLACE) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])])
    count = np.diff(np.r_[cut, len(starts)])
    a = starts[cut]
    e = a + count + window - 1
    power = np.full(len(h) + 1, _BASE)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(len(h) + 1, _INVERSE)
    back[0] = 1
    back = np.cumprod(back)
    total = np.r_[X.U64(0), np.cumsum(X.mix(h) * power[:-1])]
    whole = X.mix(((total[e] - total[a]) * back[a]) ^ X.mix(count.astype(X.U64)))
    return rows[cut], a - first[rows[cut]], count, gram[chosen[cut]], whole


def _word_hashes(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, off, buf in X.chunks(array):
        starts, ends, first = X.split(off, buf)
        yield lo, hi, X.hash_spans(buf, starts, ends), first


def occurrences(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``mh, sg, d, t, at, cnt``: every segment of every document (d, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, t = np.asarray(b.column(0)), np.asarray(b.column(1))
            for lo, _, h, first in _word_hashes(b.column(2)):
                rows, at, count, mh, sg = segments(h, first, window)
                yield pa.record_batch({
                    "mh": pa.array(mh.view(np.int64)), "sg": pa.array(sg.view(np.int64)), "d": pa.array(d[lo + rows]), "t": pa.array(t[lo + rows]),
                    "at": pa.array(at.astype(np.int32)), "cnt": pa.array(count.astype(np.int32))})

    return keyed.select("d", "t", "text").mapInArrow(run, "mh long, sg long, d long, t long, at int, cnt int")


def search_shard(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """Index one shard's segments and stream those that occur once through it.

    Returns ``d, t, at, cnt, mask``: bit j of the mask marks window at + j.
    """
    words = table.column("words").to_pylist()
    size = np.array([len(w) // 8 for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), X.U64)
    index = FMIndex(flat, np.r_[0, np.cumsum(size)])
    asked = np.flatnonzero(np.asarray(table.column("n")) == 1)
    mask = np.zeros(len(words), np.int64)
    for row, start, end in index.matches(asked, window):
        np.bitwise_or.at(mask, row, (np.int64(1) << (end - window + 1)) - (np.int64(1) << start))
    return table.select(["d", "t", "at", "cnt"]).append_column("mask", pa.array(mask)).take(pa.array(np.flatnonzero(mask)))


def _window_hashes(window: int):
    """Explode the segments of a hot minimizer in windows ``mh, wh, n, d, t, at, j``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("words").to_pylist()
            size = np.array([len(w) // 8 for w in words], np.int64)
            first = np.r_[0, np.cumsum(size)]
            at, rows = X.window_starts(first, window)
            wh = X.ngram_hashes(np.frombuffer(b"".join(words), X.U64), window)[at] if len(at) else np.zeros(0, X.U64)
            take = b.take(pa.array(rows))
            yield pa.record_batch({
                **{c: take.column(c) for c in ("mh", "n", "d", "t", "at", "cnt")},
                "wh": pa.array(wh.view(np.int64)), "j": pa.array((at - first[rows]).astype(np.int32))})

    return run


def repeats(keyed: DataFrame, window: int = WINDOW, hot: int = HOT_SEGMENTS, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """``d, t, at, cnt, mask`` of all segments with a window that occurs elsewhere."""
    spark = keyed.sparkSession
    segs = occurrences(keyed, window)
    often = C.materialize(segs.groupBy("mh").agg(F.count("*").alias("n")).where("n >= 2"), "minimizers")
    again = C.materialize(C.hot_join(segs, often, "mh", "n", "inner"), "segments")
    # one row a different segment: how often, and (if once) where
    kinds = C.materialize(
        again.withColumn("k", F.struct("mh", "sg")).groupBy("k").agg(
            F.count("*").alias("n"), F.min("d").alias("d"), F.min("t").alias("t"), F.min("at").alias("at"), F.min("cnt").alias("cnt"), F.min(F.struct("d", "t", "at")).alias("who")),
        "kinds").withColumns({"d": F.col("who.d"), "t": F.col("who.t"), "at": F.col("who.at")}).drop("who")
    whole = C.hot_join(again.withColumn("k", F.struct("mh", "sg")), kinds.where("n >= 2").select("k", "n"), "k", "n", "inner").select(
        "d", "t", "at", "cnt", (F.expr("shiftleft(1L, cnt)") - 1).alias("mask"))
    single = kinds.withColumn("mh", F.col("k.mh"))
    mixed = C.materialize(single.groupBy("mh").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds >= 2 and least = 1").drop("least"), "mixed")
    asked = C.hot_join(single.drop("k"), mixed.withColumn("w", F.col("kinds")), "mh", "w", "inner")
    spots = asked.groupBy("d", "t").agg(F.collect_list(F.struct("mh", "n", "at", "cnt", "kinds")).alias("spots"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots = b.column(3)
            for lo, hi, h, first in _word_hashes(b.column(2)):
                part = spots.slice(lo, hi - lo)
                flat, size = part.flatten(), np.asarray(part.value_lengths())
                rows = np.repeat(np.arange(hi - lo), size)
                at, cnt = np.asarray(flat.field("at")).astype(np.int64), np.asarray(flat.field("cnt")).astype(np.int64)
                begin = first[rows] + at
                raw, end = h.tobytes(), begin + cnt + window - 1
                yield pa.record_batch({
                    "mh": flat.field("mh"), "n": flat.field("n"), "kinds": flat.field("kinds"), "d": b.column(0).take(pa.array(lo + rows)), "t": b.column(1).take(pa.array(lo + rows)),
                    "at": flat.field("at"), "cnt": flat.field("cnt"), "words": pa.array([raw[8 * x : 8 * y] for x, y in zip(begin, end)], pa.binary())})

    # repeated rows share id and text: either row serves
    texts = keyed.join(spots, ["d", "t"]).select("d", "t", "text", "spots")
    shipped = texts.mapInArrow(cut, "mh long, n long, kinds long, d long, t long, at int, cnt int, words binary")
    has_hot = mixed.where(F.col("kinds") > hot).limit(1).count() > 0
    if has_hot:
        shipped = C.materialize(shipped, "shipped")
    total = mixed.agg(F.sum("kinds")).first()[0] or 0
    shards = max(1, -(-total // shard_segments))
    few = shipped.where(F.col("kinds") <= hot) if has_hot else shipped
    found = few.groupBy(F.pmod(F.xxhash64("mh"), F.lit(shards)).alias("shard")).applyInArrow(lambda t: search_shard(t, window), "d long, t long, at int, cnt int, mask long")
    if has_hot:
        windows = C.materialize(
            shipped.where(F.col("kinds") > hot).mapInArrow(_window_hashes(window), "mh long, n long, d long, t long, at int, cnt int, wh long, j int").withColumn("k", F.struct("mh", "wh")), "windows")
        twice = C.materialize(windows.groupBy("k").agg(F.sum("n").alias("w")).where("w >= 2"), "twice")
        hits = C.hot_join(windows.where("n = 1"), twice, "k", "w", "inner")
        found = found.unionByName(hits.groupBy("d", "t", "at", "cnt").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask")))
    return whole.unionByName(found)


def covered(n: int, spots: list[dict], window: int = WINDOW) -> np.ndarray:
    """Which of n words a marked window covers."""
    edge = np.zeros(n + 1, np.int32)
    for s in spots:
        bits = s["mask"]
        if bits == (1 << s["cnt"]) - 1:
            edge[s["at"]] += 1
            edge[s["at"] + s["cnt"] + window - 1] -= 1
            continue
        for j in range(s["cnt"]):
            if bits >> j & 1:
                edge[s["at"] + j] += 1
                edge[s["at"] + j + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT_SEGMENTS, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``; kept words joined by one space."""
    C.check_columns(docs, doc_id, text)
    if not SHINGLE <= window <= 61 + SHINGLE:
        raise ValueError("window must be from 5 to 66 words")
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a window of words needs 2 * window - 1 bytes
    able = F.octet_length("text") >= 2 * window - 1
    spots = repeats(keyed.where(able), window, hot, shard_segments).groupBy("d", "t").agg(F.collect_list(F.struct("at", "cnt", "mask")).alias("spots"))
    joined = keyed.where(able).join(spots, ["d", "t"], "left").select("doc_id", "text", "spots")
    rest = keyed.where(~able).select("doc_id", "text", F.lit(None).cast(joined.schema["spots"].dataType).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for raw, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = X.python_words(raw)
                n.append(len(words))
                if marks:
                    out = covered(len(words), marks, window)
                    gone.append(int(out.sum()))
                    words = list(compress(words, (~out).tolist()))
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.record_batch({"doc_id": b.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return joined.unionByName(rest).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def kept_sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
