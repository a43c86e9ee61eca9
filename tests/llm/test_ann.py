import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def rows(n=600, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    v = (centers[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    out = [(i, x.tolist(), "s") for i, x in enumerate(v)]
    # ties, hot copies and vectors that take no part
    out += [(10_000 + i, v[50].tolist(), "s") for i in range(200)]
    out += [(20_000, None, "s"), (20_050, [0.0] * dim, "s"), (20_100, [float("nan")] * dim, "s"), (20_150, [None] + [1.0] * (dim - 1), "s"), (20_200, [1.0], "s"), (None, v[0].tolist(), "s"),
            (20_250, [1e30] * dim, "s"), (20_300, (v[50] * 2).tolist(), "s"), (20_350, [float("inf")] * dim, "s"), (20_400, [], "s")]
    return out, dim


def exact(data, dim, k=5):
    use = [(i, np.array(x, float)) for i, x, _ in data if i is not None and x is not None and len(x) == dim and None not in x and np.isfinite(np.array(x, float)).all() and any(x)]
    out = {}
    for q, x in use:
        if q % 50:
            continue
        s = [(-float(x @ y / np.sqrt((x @ x) * (y @ y))), i) for i, y in use if i != q]
        out[q] = [(i, -d) for d, i in sorted((round(d, 12), i) for d, i in s)[:k]]
    return out


@pytest.mark.parametrize("factor, shard_rows", [(1.0, 8192), (1.0, 60), (ann.FACTOR, 60), (1.0, 2)])
def test_recall_against_brute_force(spark, factor, shard_rows):
    data, dim = rows()
    got = ann.search(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 50 == 0, factor=factor, sample_rows=200, shard_rows=shard_rows).collect()
    want, mine = exact(data, dim), {}
    for g in sorted(got, key=lambda g: (g["query_id"], g["rank"])):
        mine.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    assert set(mine) == set(want)
    hits = total = 0
    for q, near in want.items():
        assert len(mine[q]) == len(near) and [s for _, s in mine[q]] == sorted([s for _, s in mine[q]], reverse=True)
        hits += sum(any(i == j for j, _ in mine[q]) for i, _ in near)
        total += len(near)
    assert hits / total >= (1.0 if factor == 1.0 else 0.9)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "s"), (50, [1.0, 0.0], "s"), (3, [0.0, 1.0], "s")], SCHEMA)
    got = sorted((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 50, 1.0), (0, 2, 3, 0.0), (50, 1, 0, 1.0), (50, 2, 3, 0.0)]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_tree_with_factor_one_is_exact():
    rng = np.random.default_rng(2)
    u = ann.unit(rng.normal(size=(900, 6)))
    q = ann.unit(rng.normal(size=(40, 6)))
    tree = ann.Tree(u, bucket=16)
    at, _ = tree.search(q, np.full(40, np.inf), 5, 5, 1.0)
    assert np.array_equal(np.sort(at, axis=1), np.sort(np.argsort(ann.chord(q, u), axis=1)[:, :5], axis=1))
    assert tree.compared < 40 * 900


def test_scaled_copies_tie_by_id(spark):
    """More entries of one direction than a shard keeps for a query."""
    rng = np.random.default_rng(5)
    v = np.array([3.0, 1.0, 2.0, 5.0])
    data = [(int(i), (v * 2.0**x).tolist(), "s") for x, i in enumerate(rng.permutation(np.arange(1, 61)))]
    data += [(100 + i, x.tolist(), "s") for i, x in enumerate(rng.normal(size=(40, 4)))]
    got = ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>, score string"), F.col("vec_id").isin(1, 60), factor=1.0).collect()
    near = {q: [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == q] for q in (1, 60)}
    assert near == {1: [2, 3, 4, 5, 6], 60: [1, 2, 3, 4, 5]}


def test_repeated_rows_are_one_row(spark):
    data, dim = rows(n=400, seed=4)
    data = [d for d in data if d[0] is None or d[0] < 10_000]
    want = exact(data, dim)
    # every row six times, and one id in a third of all rows
    many = [d for d in data for _ in range(6)] + [data[7]] * 1200
    got = ann.search(spark.createDataFrame(many, SCHEMA), F.col("vec_id") % 50 == 0, factor=1.0, sample_rows=200, shard_rows=60).collect()
    mine = {}
    for g in sorted(got, key=lambda g: (g["query_id"], g["rank"])):
        mine.setdefault(g["query_id"], []).append(g["vec_id"])
    assert mine == {q: [i for i, _ in near] for q, near in want.items()}


def test_an_id_with_many_vectors_finds_others(spark):
    rng = np.random.default_rng(6)
    data = [(0, (np.ones(4) + 0.001 * rng.normal(size=4)).tolist(), "s") for _ in range(30)] + [(1 + i, rng.normal(size=4).tolist(), "s") for i in range(20)]
    got = ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>, score string"), F.col("vec_id") == 0, factor=1.0).collect()
    assert len(got) == 5 and all(g["vec_id"] != 0 for g in got)


def test_blocks_and_lengths(spark):
    """Queries in blocks, shards in parts; vectors of two lengths are searched apart."""
    rng = np.random.default_rng(3)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(500, 6)))] + [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(frame, F.col("vec_id") % 5 == 0, factor=1.0, sample_rows=64, shard_rows=16, query_block=7).collect()}
    for lo, hi in ((0, 500), (500, 560)):
        ids, m = np.array([i for i, _ in data[lo:hi]]), np.array([v for _, v in data[lo:hi]])
        for q in np.flatnonzero(ids % 5 == 0):
            s = ann.cosine(np.broadcast_to(m[q], m.shape), m)
            best = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != q][:5]
            assert [got[int(ids[q]), r] for r in range(1, 6)] == best


def test_many_parallel_vectors_tie_by_id(spark):
    rows = [(i, [x * 2.0 ** (i - 100) for x in (1.0, 2.0, 3.0)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for factor in (1.0, 1.15):
        got = ann.search(frame, F.col("vec_id") == 0, factor=factor).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5] and all(abs(r["score"] - 1) < 1e-12 for r in got)
