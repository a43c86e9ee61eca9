import random

import numpy as np
import pytest

from lexloom.llm import components as K, neardup as N
from tests.llm.helpers import NASTY, components, corpus, prose, shingles


def check(spark, rows, **how):
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    want = components([(d, t) for d, t in rows if d is not None])
    assert sorted({r["doc_id"] for r in got}) == sorted(want)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(len(shingles(t)))
    for r in got:
        assert r["component_id"] == want[r["doc_id"]], r
        assert r["n_shingles"] in texts[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    return got


def test_equals_brute_force(spark):
    check(spark, corpus(2, 80) + NASTY)
    check(spark, corpus(2, 80) + NASTY, hot_bucket=2, group_bytes=20_000)


def test_large_groups_are_confirmed_in_blocks(spark):
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):
        w = list(base)
        w[i * 2 % 80] = f"own{i}"
        rows.append((i, " ".join(w)))
    check(spark, rows, group_bytes=4_000)
    check(spark, rows, hot_bucket=3)
    assert {r["component_id"] for r in check(spark, rows)} == {0}


def test_case_and_threshold(spark):
    rows = [(1, "A b C d E f G"), (2, "a B c D e F g"), (3, "Ä b c d e"), (4, "ä b c d e"), (5, "t u v"), (6, "T u v"), (7, "t u")]
    assert {r["doc_id"]: r["component_id"] for r in check(spark, rows)} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_empty_table_and_columns_pass(spark):
    assert check(spark, []) == []
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, "a b c d e f", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted(map(tuple, N.keep_first(df).collect()), key=str) == [(1, "a b c d e f", "x"), (None, "a b c d e f", "z")]


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(0)
    for share in (0.7, 0.8, 0.9):
        errors = []
        for _ in range(30):
            both, own = int(2000 * share), 2000 - int(2000 * share)
            a = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
            x, y = np.sort(a[: both + own]), np.sort(np.r_[a[:both], a[both + own :]])
            v = np.concatenate([x, y])
            m = N.minhashes(v, np.array([0, len(x), len(v)]))
            o = N.odd_sketches(m)
            errors.append(N.estimate(o[:1], o[1:])[0, 0] - both / (both + 2 * own))
        assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.1


@pytest.mark.parametrize("local", [10**6, 0])
def test_components(spark, local):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(25)] + [(5, 5), (None, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {x["doc_id"]: x["component"] for x in K.connected(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    assert got == {x: find(x) for x in root}
    assert K.connected(spark.createDataFrame([], "a long, b long"), local).count() == 0


def test_large_groups_in_blocks_equal_brute_force(spark):
    """A group far over group_bytes: main trees are bridged, the rest visits all blocks."""
    r = random.Random(7)
    base = prose(200, 1)
    rows = []
    for i in range(120):  # near copies of one text, and some of them further off
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 12, 25])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(7, " ".join(prose(200, 2))), (500, " ".join(prose(200, 2)))]  # an id with two texts
    got = {x["doc_id"]: x["component_id"] for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=20_000, hot_bucket=30).collect()}
    assert got == components(rows)
