"""Op 10: nearest neighbours by cosine with vantage-point trees per shard.

Unit vectors are compared by chord length, a metric that orders like cosine.
A small *top tree*, fitted on a bounded sample (``sample_rows``), cuts space in
shards; every row is indexed in its shard.  A query goes to the shards whose
triangle-inequality lower bound, times ``factor``, does not exceed the distance
of its k-th nearest sample row (an upper bound of the true one).  Inside a shard
a vantage-point tree is walked with the same relaxed pruning.  Factor one
restores exact search; larger factors prune more.

Queries that go to one shard are dealt to blocks of about ``query_block``, each with
the shard's entries beside it, so no task holds an unbounded number of either.

Equal vectors are one entry that keeps the smallest ids that can matter (k+1),
merged map-side first, so a vector shared by a third of all rows is no hot
group and loses no result.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part, as queries or candidates; vectors of different lengths have no cosine, so
each length is searched by itself; null ids take no part; only id and vector are
read, so further columns can't clash; rows that repeat an id and its vector are one
row; an id with several vectors is a candidate, and a query, with each of them,
and never its own neighbour; with fewer than k candidates all are returned; ties
go to the smaller id, however many entries of one direction (scaled copies) tie:
a query whose kept entries reach into the rounding error of its last needed
distance compares all entries of the shard; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import common as C

OUT = "query_id long, rank int, vec_id long, score double"
SAMPLE_ROWS, SHARD_ROWS, BUCKET_ROWS, QUERY_BLOCK, FACTOR = 8_192, 8_192, 192, 4_096, 1.15


def matrix(array: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, float64 matrix) of the usable vectors of a list array."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_list(pa.float64()))
    length = np.asarray(array.value_lengths().fill_null(-1))
    at = np.flatnonzero(length == dim)
    if not len(at):
        return at, np.zeros((0, dim))
    flat = array.take(pa.array(at)).flatten()
    m = np.asarray(flat.fill_null(float("nan"))).reshape(-1, dim)
    big = np.abs(m).max(axis=1) if dim else np.zeros(len(at))
    good = np.isfinite(big) & (big > 0)
    return at[good], m[good]


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, each row summed alike.

    Scaling by a power of two first is exact and keeps huge values finite.
    """
    scale = lambda m: np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])
    if len(a):
        a, b = scale(a), scale(b)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def slack(dim: int) -> float:
    """Bound of a chord's rounding error (largest near zero, where it is a root)."""
    return math.sqrt(8 * (dim + 8) * np.finfo(float).eps)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


@dataclass
class Top:
    """Heap-ordered top tree: node i has children 2i+1 (inside) and 2i+2."""

    points: np.ndarray
    radii: np.ndarray

    @property
    def shards(self) -> int:
        return len(self.points) + 1

    def shard(self, u: np.ndarray) -> np.ndarray:
        node = np.zeros(len(u), np.int64)
        for _ in range(int(math.log2(self.shards))):
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (u * self.points[node]).sum(axis=1)))
            node = 2 * node + 1 + (d > self.radii[node])
        return node - len(self.points)

    def bounds(self, u: np.ndarray) -> np.ndarray:
        """Lower bound of the distance to anything in each shard."""
        low = np.zeros((len(u), 1))
        first = 0
        for _ in range(int(math.log2(self.shards))):
            n = low.shape[1]
            d = chord(u, self.points[first : first + n]) - self.radii[first : first + n]
            low = np.stack([np.maximum(low, d), np.maximum(low, -d)], axis=2).reshape(len(u), -1)
            first = 2 * first + 1
        return low


def fit_top(sample: np.ndarray, shards: int) -> Top:
    """Split a bounded sample at median distances from far-off vantage points."""
    depth = int(math.log2(shards))
    points, radii = np.zeros((2**depth - 1, sample.shape[1])), np.zeros(2**depth - 1)
    groups = {0: np.arange(len(sample))}
    for i in range(2**depth - 1):
        g = groups.pop(i)
        if not len(g):
            points[i, 0] = 1.0
            groups[2 * i + 1] = groups[2 * i + 2] = g
            continue
        points[i] = sample[g[int(np.argmax(chord(sample[g[:1]], sample[g])[0]))]]
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (sample[g] * points[i]).sum(axis=1)))
        radii[i] = np.median(d)
        groups[2 * i + 1], groups[2 * i + 2] = g[d <= radii[i]], g[d > radii[i]]
    return Top(points, radii)


class Tree:
    """Vantage-point tree of one shard, searched for many queries at a time."""

    def __init__(self, u: np.ndarray, bucket: int = BUCKET_ROWS):
        self.u, self.bucket = u, bucket
        self.root = self._build(np.arange(len(u)))
        self.compared = 0

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.bucket:
            return rows
        v = self.u[rows[int(np.argmax(chord(self.u[rows[:1]], self.u[rows])[0]))]]
        d = chord(v[None], self.u[rows])[0]
        mu = float(np.median(d))
        inside = d <= mu
        if inside.all():  # as good as equal: no split by distance can help
            return rows
        return v, mu, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, q: np.ndarray, bound: np.ndarray, keep: int, need: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The ``keep`` nearest entries of each query (-1: none) and distances.

        ``bound`` is each query's known upper bound of its need-th distance.
        """
        at, dist = np.full((len(q), keep), -1), np.full((len(q), keep), np.inf)
        rounding = slack(self.u.shape[1])
        tau = bound + rounding

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                for lo in range(0, len(node), 4096):
                    part = node[lo : lo + 4096]
                    d = chord(q[rows], self.u[part])
                    self.compared += d.size
                    both = np.concatenate([dist[rows], d], axis=1)
                    ids = np.concatenate([at[rows], np.broadcast_to(part, d.shape)], axis=1)
                    best = np.argsort(both, axis=1, kind="stable")[:, :keep]
                    dist[rows], at[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(ids, best, 1)
                    tau[rows] = np.minimum(tau[rows], dist[rows, need - 1] + rounding)
                return
            v, mu, inside, outside = node
            d = chord(q[rows], v[None])[:, 0]
            near = d <= mu
            visit(inside, rows[near])
            visit(outside, rows[~near])
            visit(outside, rows[near & (factor * (mu - d) <= tau[rows])])
            visit(inside, rows[~near & (factor * (d - mu) <= tau[rows])])

        visit(self.root, np.arange(len(q)))
        return at, dist

    def unsure(self, dist: np.ndarray, need: int) -> np.ndarray:
        """Queries of a search whose last kept entry is within rounding of the need-th."""
        return np.isfinite(dist[:, -1]) & (dist[:, -1] <= dist[:, need - 1] + 2 * slack(self.u.shape[1]))


def rank_all(q: np.ndarray, own: int, e: np.ndarray, members: list[list[int]], heads: tuple[np.ndarray, ...], k: int) -> list[tuple[int, float]]:
    """The k best ``(id, score)`` of one query, compared with every entry."""
    s = np.concatenate([cosine(np.broadcast_to(q, e[lo : lo + 4096].shape), e[lo : lo + 4096]) for lo in range(0, len(e), 4096)])
    head, second, size = heads
    first = np.where(head == own, second, head)
    at = np.flatnonzero((head != own) | (size > 1))
    # each of the entries before it holds a better id, so the first k entries hold the k best
    at = at[np.lexsort((first[at], -s[at]))[:k]]
    return sorted(((i, s[x]) for x in at for i in members[x] if i != own), key=lambda p: (-p[1], p[0]))[:k]


def _distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """(key, vector bytes, up to ``keep`` smallest ids) of equal vectors."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.to_pandas().sort_values("id", kind="stable")
            t = t[t.groupby("v", sort=False).cumcount() < keep]
            yield pa.RecordBatch.from_pandas(t, schema=b.schema, preserve_index=False)

    few = vectors.select("id", "v").mapInArrow(local, "id long, v binary").distinct()
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return few.withColumn("_r", rank).where(F.col("_r") <= keep).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def search(rows: DataFrame, queries, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, factor: float = FACTOR,
           sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of every row where ``queries`` holds."""
    C.check_columns(rows, id_col, vector)
    rows = rows.where(F.col(id_col).isNotNull() & (F.size(vector) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("q"))
    # a row a length; those without a query, or with a query alone, have nothing to return
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max("q").alias("q")).where("n > 1 and q").orderBy("d").collect()
    found = [_search(rows.where(F.size("vector") == r["d"]), int(r["d"]), k, factor, sample_rows, shard_rows, query_block) for r in lengths]
    if not found:
        return rows.sparkSession.createDataFrame([], OUT)
    # an id with vectors of several lengths is a query with each: its best k of all
    found = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, dim: int, k: int, factor: float, sample_rows: int, shard_rows: int, query_block: int) -> DataFrame:
    """``query_id, vec_id, score`` of ``id, vector, q`` of one length, k of each shard at most."""
    nothing = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = matrix(b.column(1), dim)
            m = m + 0.0  # -0.0 equals 0.0
            yield pa.record_batch({"id": b.column(0).take(pa.array(at)), "v": pa.array([r.tobytes() for r in m], pa.binary()), "q": b.column(2).take(pa.array(at))})

    # repeated rows are made one here, map-side first: they would count in the sample, its bounds and the ranks
    vectors = C.materialize(
        rows.mapInArrow(clean, "id long, v binary, q boolean").groupBy("id", "v").agg(F.max("q").alias("q")), "vectors")
    total = vectors.count()
    if not total:
        return nothing
    # at most sample_rows rows; they bound distances and shape the top tree, nothing else
    drawn = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).select("id", "v").toPandas()
    s_id = drawn.id.to_numpy()
    s_unit = unit(np.frombuffer(b"".join(drawn.v), np.float64).reshape(-1, dim))
    shards = 2 ** max(0, min(math.ceil(math.log2(max(1, total / shard_rows))), int(math.log2(max(1, len(drawn) // 8)))))
    # the sample bounds the number of shards; larger ones are dealt to parts by hash, and a query asks every part
    parts = max(1, math.ceil(total / (shards * 4 * shard_rows)))
    shared = rows.sparkSession.sparkContext.broadcast((fit_top(s_unit, shards), s_id, s_unit))
    keep = 2 * k + 6

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value[0]
        for b in batches:
            if b.num_rows:
                u = unit(np.frombuffer(b"".join(b.column(0).to_pylist()), np.float64).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([pa.array(top.shard(u), pa.int32()), *b.columns], names=["shard", *b.schema.names])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, ids, points = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                v = part.column(1).to_pylist()
                u = unit(np.frombuffer(b"".join(v), np.float64).reshape(-1, dim))
                d = chord(u, points)
                own = np.asarray(part.column(0))
                d[own[:, None] == ids[None]] = np.inf
                bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(u), np.inf)
                r, s = np.nonzero(factor * top.bounds(u) <= bound[:, None] + slack(dim))
                yield pa.record_batch({"shard": pa.array(s, pa.int32()), "id": pa.array(own[r]), "v": pa.array([v[i] for i in r], pa.binary()), "bound": pa.array(bound[r])})

    def find(key, entries: pa.Table, asked: pa.Table) -> pa.Table:
        ids, near, score = [], [], []
        if entries.num_rows and asked.num_rows:
            e = np.frombuffer(b"".join(entries.column("v").to_pylist()), np.float64).reshape(-1, dim)
            members = entries.column("ids").to_pylist()
            tree = Tree(unit(e))
            own = np.asarray(asked.column("id"))
            heads = tuple(np.array(x, np.int64) for x in zip(*[(m[0], m[min(1, len(m) - 1)], len(m)) for m in members]))
            # ids with several entries: those of the query itself would use up the kept places
            seen, times = np.unique(np.fromiter((i for m in members for i in m), np.int64), return_counts=True)
            several = seen[times > 1]
            for lo in range(0, len(own), 1024):
                part = asked.slice(lo, 1024)
                q = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(-1, dim)
                at, dist = tree.search(unit(q), np.asarray(part.column("bound")), keep, k + 1, factor)
                whole = tree.unsure(dist, k + 1) | np.isin(own[lo : lo + len(q)], several)
                at[whole] = -1
                for x in np.flatnonzero(whole):
                    for i, s in rank_all(q[x], own[lo + x], e, members, heads, k):
                        ids.append(own[lo + x])
                        near.append(i)
                        score.append(s)
                r, c = np.nonzero(at >= 0)
                s = cosine(q[r], e[at[r, c]])
                frame = pd.DataFrame({"q": own[lo + r], "i": [members[x] for x in at[r, c]], "s": s}).explode("i")
                frame = frame[frame.q != frame.i].sort_values(["q", "s", "i"], ascending=[True, False, True])
                frame = frame[frame.groupby("q").cumcount() < k]
                ids.extend(frame.q)
                near.extend(frame.i)
                score.extend(frame.s)
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    asked = C.materialize(C.spread(vectors.where("q"), "id").select("id", "v").mapInArrow(route, "shard int, id long, v binary, bound double"), "asked")
    # at most as many rows as shards, which the sample bounds
    blocks = F.broadcast(asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("blocks")))
    index = _distinct(vectors, k + 1).mapInArrow(assign, "shard int, v binary, ids array<long>").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int"))
    index = index.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["shard", "part", "block"]
    return index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score double")
