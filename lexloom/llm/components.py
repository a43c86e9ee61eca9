"""Connected components of an edge table, labelled by the smallest id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import common as C

#: Edge tables counted at or below this are labelled in one bounded task.
LOCAL_EDGES = 2_000_000


def label(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and smallest reachable node, by vectorised hooking and jumping."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        ru, rv = root[u], root[v]
        lo, hi = np.minimum(ru, rv), np.maximum(ru, rv)
        np.minimum.at(root, hi, lo)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return nodes, nodes[root]


def connected(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``doc_id, component`` for every node of ``edges(a, b)``.

    Small edge tables (by count) are labelled in one task.  Larger ones shrink
    by alternating large-star and small-star steps, each one shuffle with
    map-side distinct, written out between steps; a hub's edges are never
    gathered: its smallest neighbour is an aggregate.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if edges.limit(local_edges + 1).count() <= local_edges:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(batches)
            if parts:
                a = np.concatenate([np.asarray(p.column(0)) for p in parts])
                b = np.concatenate([np.asarray(p.column(1)) for p in parts])
                node, root = label(a, b)
                yield pa.record_batch({"doc_id": pa.array(node), "component": pa.array(root)})

        return edges.coalesce(1).mapInArrow(run, "doc_id long, component long")
    edges = C.materialize(edges, "edges")
    while True:
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large star: bigger neighbours move to the smallest neighbour
        large = C.hot_join(both.where("b > a"), least, "a", "n").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = C.materialize(large, "large")
        # small star: a node and its smaller neighbours move to the smallest of them
        down = large.select(F.col("b").alias("n"), F.col("a").alias("s"))
        least = down.groupBy("n").agg(F.min("s").alias("m"), F.count("*").alias("w"))
        moved = C.hot_join(down, least, "n", "w")
        small = moved.where("s <> m").select(F.col("m").alias("a"), F.col("s").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()
        edges = C.materialize(small, "small")
        if edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == before:
            break
    roots = edges.select(F.col("a").alias("doc_id"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("component")).unionByName(roots)
