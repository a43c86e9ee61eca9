"""Op 2: near-duplicates by MinHash bands, odd sketches and exact confirmation.

A document's set holds its distinct 5-word shingles.  One map over the texts
makes MinHash band keys and an *odd sketch*: MinHash samples folded into a
parity bitmap.  Documents of equal sets are one class from here on.  Class
representatives that share a band key are compared by the population count of
the XOR of their odd sketches, which estimates high similarities precisely;
estimates clearly below the threshold are dropped.  What remains is joined to
*candidate groups*, each group's full sets are brought together once, and links
are confirmed on the full sets.  Candidates are linked within groups only, so a
component never spans two groups.

Nothing is capped: a bucket too large for one task joins its documents to one of
them without comparing their sketches, and a group whose sets exceed ``group_bytes`` is
confirmed in blocks of bounded size: first inside each block, then between the
blocks' main trees, and then what no main tree holds yet against every block, so a
group of like documents costs in proportion to its size.  Bands are chosen so that a link at the
threshold is missed with a probability of about 5e-8 (40 bands of 3).

Cases: null, empty and blank texts have an empty set (n_shingles 0), are linked
with nothing and kept; texts of fewer than five words are one shingle, the whole
sequence; words compare with A-Z lower-cased; rows repeated with one id are one
document (their ids agree, so they fall in one component; each of its texts is
compared); null ids are left out of the result; ties go to the smaller id; texts
are never cut; only id and text are read, so further columns can't clash; an empty
table gives an empty result.  Sets hold 64-bit hashes of shingles: links are exact
but for hash collisions (two different shingles of a pair agree with 2^-64).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import common as C
from lexloom.llm import components
from lexloom.llm import textnp as X

N, BANDS, ROWS, BITS = 5, 40, 3, 1024
GROUP_BYTES, HOT_BUCKET = 48 << 20, 8_192
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(array: pa.Array, n: int = N) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, sorted distinct shingle hashes, offsets per row)."""
    for lo, hi, off, buf in X.chunks(array):
        buf = X.LOWER[buf]
        starts, ends, first = X.split(off, buf)
        h = X.hash_spans(buf, starts, ends)
        at, rows = X.window_starts(first, n)
        v = X.ngram_hashes(h, n)[at]
        for i in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n)):
            whole = h[first[i] : first[i + 1]]
            v = np.append(v, X.ngram_hashes(whole, len(whole)) ^ X.U64(len(whole)))
            rows = np.append(rows, i)
        order = np.lexsort((v, rows))
        v, rows = v[order], rows[order]
        if len(v):
            new = np.r_[True, (v[1:] != v[:-1]) | (rows[1:] != rows[:-1])]
            v, rows = v[new], rows[new]
        yield lo, hi, v, np.searchsorted(rows, np.arange(hi - lo + 1))


def minhashes(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, BANDS*ROWS) 32-bit MinHash samples; rows without shingles are 0."""
    out = np.zeros((len(first) - 1, BANDS * ROWS), np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        v32 = (v >> X.U64(32)).astype(np.uint32) ^ v.astype(np.uint32)
        for k in range(BANDS * ROWS):
            out[full, k] = np.minimum.reduceat((v32 + _ADD[k]) * _MUL[k], first[full])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.empty((len(samples), BANDS), X.U64)
    for b in range(BANDS):
        k = np.full(len(samples), X.U64(b + 1))
        for r in range(ROWS):
            k = X.mix((k * X.U64(0x9E3779B97F4A7C15)) ^ samples[:, b * ROWS + r].astype(X.U64))
        keys[:, b] = k
    return keys


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps of the (position, value) pairs of the MinHash samples."""
    n, k = samples.shape
    h = X.mix(samples.astype(X.U64) * X.U64(0xD1B54A32D192ED03) + np.arange(1, k + 1, dtype=X.U64)[None])
    slot = (h % X.U64(bits)).astype(np.int64) + np.arange(n)[:, None] * bits
    parity = (np.bincount(slot.ravel(), minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(parity, axis=1)


def estimate(a: np.ndarray, b: np.ndarray, samples: int = BANDS * ROWS, bits: int = BITS) -> np.ndarray:
    """Estimated similarities of sketches a against sketches b (matrix)."""
    a64, b64 = a.view(X.U64), b.view(X.U64)
    odd = np.zeros((len(a), len(b)), np.int64)
    for w in range(a64.shape[1]):
        odd += np.bitwise_count(a64[:, w, None] ^ b64[None, :, w])
    share = np.minimum(2.0 * odd / bits, 0.999)
    return 1.0 + bits / (4.0 * samples) * np.log1p(-share)


def _margin(threshold: float) -> float:
    """Six standard errors below the threshold: what is dropped can't be a link."""
    return threshold - 6.0 * np.sqrt(threshold * (1 - threshold) / (BANDS * ROWS))


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, bands, odd``: one map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, v, first in shingle_sets(b.column(1), n):
                size = np.diff(first)
                full = np.flatnonzero(size > 0)
                prints = np.zeros((2, hi - lo), X.U64)
                if len(full):
                    prints[0, full] = np.add.reduceat(X.mix(v), first[full])
                    prints[1, full] = np.bitwise_xor.reduceat(X.mix(v + X.U64(0x5851F42D4C957F2D)), first[full])
                samples = minhashes(v, first)
                keys, odd = band_keys(samples), odd_sketches(samples)
                yield pa.record_batch({
                    "doc_id": b.column(0).slice(lo, hi - lo), "n_shingles": pa.array(size.astype(np.int64)),
                    "f1": pa.array(prints[0].view(np.int64)), "f2": pa.array(prints[1].view(np.int64)),
                    "bands": pa.array([r.tobytes() if s else None for r, s in zip(keys, size)], pa.binary()),
                    "odd": pa.array([r.tobytes() if s else None for r, s in zip(odd, size)], pa.binary())})

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, bands binary, odd binary")


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
        yield pa.record_batch({"key": pa.array(keys), "doc_id": pa.array(np.repeat(np.asarray(b.column(0)), BANDS))})


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys out of key-sorted batches."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.asarray(b.column(key))
        cut = int(np.searchsorted(k, k[-1]))
        if cut == 0 and (not rest or np.asarray(rest[-1].column(key))[-1] == k[0]):
            rest.append(b)
            continue
        done = pa.Table.from_batches([*rest, b.slice(0, cut)])
        if done.num_rows:
            yield done
        rest = [b.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def bucket_edges(ids: np.ndarray, odd: np.ndarray, low: float, block: int = 256) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of one bucket whose estimate is >= low.

    Works in blocks.  A row is compared to the leaders of the trees so far, and
    then to members of trees it is not yet in, so a coherent bucket of any size
    takes about one comparison a row, and no pair is lost.
    """
    n = len(ids)
    tree = np.arange(n)
    left: list[int] = []
    right: list[int] = []

    def join(i: int, j: int) -> None:
        a, b = tree[i], tree[j]
        if a != b:
            left.append(int(ids[i]))
            right.append(int(ids[j]))
            tree[tree == max(a, b)] = min(a, b)

    for lo in range(0, n, block):
        hi = min(lo + block, n)
        if lo:
            leaders = np.unique(tree[:lo])
            for part in range(0, len(leaders), 4096):
                own = leaders[part : part + 4096]
                good = estimate(odd[lo:hi], odd[own]) >= low
                for i in np.flatnonzero(good.any(axis=1)):
                    for j in own[good[i]]:
                        join(int(j), lo + int(i))
        home = tree[lo:hi].copy()
        for t in np.unique(home):
            mine = lo + np.flatnonzero(home == t)
            others = np.flatnonzero(tree[:hi] != tree[mine[0]])
            for part in range(0, len(others), 4096):
                own = others[part : part + 4096]
                good = estimate(odd[mine], odd[own]) >= low
                for i, j in zip(*np.nonzero(good)):
                    join(int(own[j]), int(mine[i]))
    return left, right


def candidate_edges(reps: DataFrame, threshold: float, hot: int = HOT_BUCKET) -> DataFrame:
    """``a, b``: a spanning forest of each bucket's likely links.

    Buckets are sized by an aggregate first.  One of more than ``hot`` documents
    is never gathered: its documents all join its smallest one, which loses no
    pair (what isn't alike is told apart when links are confirmed).
    """
    low = _margin(threshold)
    keyed = reps.select("doc_id", "bands").mapInArrow(_explode_bands, "key long, doc_id long")
    often = C.materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n >= 2"), "often")
    found = C.materialize(C.hot_join(keyed, often.withColumn("size", F.col("n")), "key", "n", "inner"), "buckets")
    shared = found.where(F.col("size") <= hot).select("key", "doc_id")
    stars = found.where((F.col("size") > hot) & (F.col("doc_id") > F.col("least"))).select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "key"):
            keys, ids = np.asarray(table.column("key")), np.asarray(table.column("doc_id"))
            odd = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint8).reshape(len(ids), -1)
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            left, right = [], []
            pairs = cut[:-1][np.diff(cut) == 2]
            if len(pairs):  # most buckets are pairs: all at once
                x = np.bitwise_count(odd[pairs].view(X.U64) ^ odd[pairs + 1].view(X.U64)).sum(axis=1)
                est = 1.0 + BITS / (4.0 * BANDS * ROWS) * np.log1p(-np.minimum(2.0 * x / BITS, 0.999))
                left.extend(ids[pairs[est >= low]].tolist())
                right.extend(ids[pairs[est >= low] + 1].tolist())
            for lo, hi in zip(cut[:-1], cut[1:]):
                if hi - lo > 2:
                    a, b = bucket_edges(ids[lo:hi], odd[lo:hi], low)
                    left.extend(a)
                    right.extend(b)
            a, b = np.array(left, np.int64), np.array(right, np.int64)
            yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    sketches = reps.select("doc_id", "odd").join(shared.select("doc_id").distinct(), "doc_id", "left_semi")
    return (
        C.spread(shared.join(sketches, "doc_id"), "key").sortWithinPartitions("key", "doc_id")
        .mapInArrow(edges, "a long, b long").distinct().unionByName(stars)
    )


class Sets:
    """Full sets of some documents, concatenated."""

    def __init__(self, ids: np.ndarray, sets: list[bytes]):
        self.ids = ids
        self.sizes = np.array([len(s) // 8 for s in sets], np.int64)
        self.values = np.frombuffer(b"".join(sets), X.U64)
        self.first = np.r_[0, np.cumsum(self.sizes)]
        self.owner = np.repeat(np.arange(len(ids)), self.sizes)

    def get(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i + 1]]


def _links(x: np.ndarray, others: Sets, rows: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those of ``rows`` whose full set reaches the threshold with set x (exact)."""
    size = others.sizes[rows]
    near = (den * np.minimum(size, len(x)) >= num * np.maximum(size, len(x)))
    rows = rows[near]
    if not len(rows):
        return rows
    count = others.sizes[rows]
    at = np.repeat(others.first[rows] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    v = others.values[at]
    slot = np.minimum(np.searchsorted(x, v), len(x) - 1)
    common = np.bincount(np.repeat(np.arange(len(rows)), count), x[slot] == v, len(rows)).astype(np.int64)
    union = count + len(x) - common
    return rows[den * common >= num * union]


def confirm(a: Sets, b: Sets | None, num: int, den: int, tree: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Spanning links among a (b None) or between a and b, on full sets.

    Rows already in one component are not compared again; every pair of rows in
    different components is.
    """
    left: list[int] = []
    right: list[int] = []
    if b is None:
        comp = np.arange(len(a.ids))
        order = np.argsort(-a.sizes, kind="stable")
        for k, i in enumerate(order):
            i = int(i)
            done = order[:k]
            leaders = np.unique(comp[done])
            hit = _links(a.get(i), a, leaders, num, den)
            rest = done[~np.isin(comp[done], comp[hit])] if len(hit) else done
            for j in [*hit, *_links(a.get(i), a, rest, num, den)]:
                p, q = comp[i], comp[j]
                if p != q:
                    left.append(int(a.ids[i]))
                    right.append(int(a.ids[j]))
                    comp[comp == max(p, q)] = min(p, q)
        return left, right
    ca, cb = tree[: len(a.ids)], tree[len(a.ids) :]
    for i in range(len(a.ids)):
        rest = np.flatnonzero(cb != ca[i])
        for j in _links(a.get(i), b, rest, num, den):
            p, q = ca[i], cb[j]
            if p != q:
                left.append(int(a.ids[i]))
                right.append(int(b.ids[j]))
                old, new = max(p, q), min(p, q)
                ca[ca == old] = new
                cb[cb == old] = new
    return left, right


def _confirmed(docs: DataFrame, groups: DataFrame, sizes: DataFrame, num: int, den: int, n: int, group_bytes: int) -> DataFrame:
    """Exact links ``a, b`` inside candidate groups (``doc_id, component``)."""
    schema = "a long, b long"
    weighed = C.materialize(groups.join(sizes, "doc_id").groupBy("component").agg((F.sum("n_shingles") * 8).alias("bytes"), F.count("*").alias("members")), "weighed")
    members = C.hot_join(groups, weighed, "component", "members", "inner")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, v, first in shingle_sets(b.column(3), n):
                part = b.slice(lo, hi - lo)
                yield pa.record_batch({
                    "component": part.column(0), "bytes": part.column(1), "doc_id": part.column(2),
                    "s": pa.array([v[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())})

    full = (
        docs.join(members.select("doc_id", "component", "bytes"), "doc_id")
        .select("component", "bytes", "doc_id", "text")
        .mapInArrow(sets, "component long, bytes long, doc_id long, s binary")
    )

    def one(table: pa.Table) -> pa.Table:
        s = Sets(np.asarray(table.column("doc_id")), table.column("s").to_pylist())
        left, right = confirm(s, None, num, den)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    hot = weighed.where(F.col("bytes") > group_bytes).limit(1).count()
    if not hot:
        return full.groupBy("component").applyInArrow(one, schema)
    full = C.materialize(full, "sets")
    normal = full.where(F.col("bytes") <= group_bytes).groupBy("component").applyInArrow(one, schema)
    # a group too large for one task: links inside blocks, then block against block
    blocks = full.where(F.col("bytes") > group_bytes).withColumn("blocks", F.ceil(2 * F.col("bytes") / F.lit(group_bytes)).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    inside = C.materialize(blocks.groupBy("component", "block").applyInArrow(one, schema), "inside")
    rows = blocks.select("component", "block", "blocks", "doc_id", (F.length("s")).alias("bytes")).distinct()

    def trees(links: DataFrame) -> DataFrame:
        """``rows`` with the tree of each document."""
        label = components.connected(links).select("doc_id", F.col("component").alias("tree"))
        return rows.join(label, "doc_id", "left").withColumn("tree", F.coalesce("tree", "doc_id"))

    def largest(of: DataFrame, *keys: str) -> DataFrame:
        size = of.groupBy(*keys, "tree").agg(F.count("*").alias("w"))
        return size.groupBy(*keys).agg(F.max_by("tree", F.struct("w", -F.col("tree"))).alias("tree"))

    # the largest tree of each block, by its first document: one a block, so this group is small
    heads = largest(trees(inside), "component", "block").select("component", F.col("tree").alias("doc_id"))
    bridges = C.materialize(blocks.join(heads, ["component", "doc_id"], "left_semi").groupBy("component").applyInArrow(one, schema), "bridges")
    found = C.materialize(trees(inside.unionByName(bridges)), "trees")
    # members of a component's main tree are joined already: only the others still visit all blocks,
    # in parts of bounded size
    main = largest(found, "component").withColumnRenamed("tree", "main")
    found = found.join(main, "component").withColumn("guest", F.col("tree") != F.col("main"))
    tours = found.where("guest").groupBy("component").agg(F.ceil(2 * F.sum("bytes") / F.lit(group_bytes)).cast("int").alias("tours"))
    sided = blocks.select("doc_id", "s").join(found.join(tours, "component").drop("bytes"), "doc_id")
    natives = sided.withColumn("tour", F.explode(F.sequence(F.lit(0), F.col("tours") - 1))).withColumn("first", F.lit(False))
    guests = sided.where("guest").withColumn("tour", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.col("tours")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.lit(True))
    sides = natives.unionByName(guests).select("component", "block", "tour", "first", "doc_id", "s", "tree")

    def across(table: pa.Table) -> pa.Table:
        first = np.asarray(table.column("first"))
        parts = [table.filter(pa.array(m)) for m in (first, ~first)]
        a, b = (Sets(np.asarray(p.column("doc_id")), p.column("s").to_pylist()) for p in parts)
        tree = np.concatenate([np.asarray(p.column("tree")) for p in parts])
        left, right = confirm(a, b, num, den, tree)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return normal.unionByName(inside).unionByName(bridges).unionByName(sides.groupBy("component", "block", "tour").applyInArrow(across, schema))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 70, den: int = 100, n: int = N, group_bytes: int = GROUP_BYTES, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Links hold where ``den * |a & b| >= num * |a | b|``.
    """
    C.check_columns(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = C.materialize(sketch(docs, n=n), "sketches")
    filled = sketches.where("n_shingles > 0")
    classes = filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = C.materialize(classes, "classes")
    # rows of one id and different texts all speak for it
    reps = filled.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2", "n_shingles"), ["doc_id", "f1", "f2", "n_shingles"], "left_semi").dropDuplicates(["doc_id", "f1", "f2", "n_shingles"])
    edges = C.materialize(candidate_edges(reps, num / den, hot_bucket), "candidates")
    groups = C.materialize(components.connected(edges), "groups")
    sizes = reps.select("doc_id", "n_shingles")
    first = docs.where(F.col("doc_id").isNotNull())
    links = C.materialize(_confirmed(first, groups, sizes, num, den, n, group_bytes).distinct(), "links")
    linked = components.connected(links)
    labelled = classes.join(linked.withColumnRenamed("doc_id", "rep"), "rep", "left").select("f1", "f2", "n_shingles", "copies", F.coalesce("component", "rep").alias("component_id"))
    # equal sets may be a third of all rows; the class side has one row a key
    out = C.hot_join(
        sketches.select("doc_id", "n_shingles", F.struct("f1", "f2", "n_shingles").alias("k")),
        labelled.select(F.struct("f1", "f2", "n_shingles").alias("k"), "copies", "component_id"), "k", "copies")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All columns of the documents that ``near_duplicates`` keeps.

    Null ids are kept (they were not compared); of rows that repeat a kept id all
    are kept, as they are one document.
    """
    (name,) = C.fresh(docs, "gone")
    gone = near_duplicates(docs, doc_id, text, **how).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
