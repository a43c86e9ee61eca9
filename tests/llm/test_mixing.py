import duckdb
import pytest

from lexloom.llm import mixing as M, queries
from tests.llm.helpers import words


def filled(sizes, weights, total=1.5, cap=2.0):
    """Targets, one source fixed at a time."""
    left, free, out = total * sum(sizes), set(range(len(sizes))), {}
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > cap * sizes[i]]
        if not over:
            return [out.get(i, weights[i] * level) for i in range(len(sizes))]
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            free.discard(i)
    return [out[i] for i in range(len(sizes))]


def rows():
    out = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", "w " * (1 + i % 40)) for i in range(400)]
    out += [(1000 + i, None, "n " * 9) for i in range(30)]
    return out + [(2000, "s1", None), (2001, "empty", ""), (2002, "", "one two"), (5, "s5", "w " * 6), (None, "s2", "x y"), (2003, "Z\U0001f642", "a"), (2004, "Z\uffee", "b")]


def test_targets_sizes_and_copies(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows()], "doc_id long, source string, text string, size int, _k string")
    got = M.mix(df).collect()
    assert len(got) == len(rows())
    order = sorted({r[1] for r in rows()}, key=lambda s: (s is None, s or ""))
    size = [sum(len(words(t)) for _, s, t in rows() if s == name) for name in order]
    want = dict(zip(order, zip(size, filled(size, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))]))))
    for g in got:
        assert g["source_size"] == want[g["source"]][0] and g["target"] == pytest.approx(want[g["source"]][1], rel=1e-12)
        assert g["size"] == len(words(g["text"])) and g["taken"] == g["copies"] * g["size"] and g["copies"] <= 2
    assert sum(want[s][1] for s in want) <= 1.5 * sum(size) + 1e-6
    again = {(g["doc_id"], g["text"]): g["taken"] for g in M.mix(df).collect()}
    assert all(again[(g["doc_id"], g["text"])] == g["taken"] for g in got)
    emitted = M.emit(M.mix(df))
    assert emitted.count() == sum(g["copies"] for g in got)


def test_sources_come_near_their_targets(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", "w " * 10) for i in range(8000)], "doc_id long, source string, text string")
    for r in M.mix(df).groupBy("source", "target").sum("taken").collect():
        assert abs(r["sum(taken)"] - r["target"]) < 0.05 * r["target"]


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_hot_join_beyond_the_broadcast_bound(spark, monkeypatch):
    from lexloom.llm import common

    monkeypatch.setattr(common, "small", lambda df, limit=0: (df, False))
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string")
    assert M.mix(df).count() == len(rows())


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.OP4_SQL).df().sort_values("doc_id").reset_index(drop=True)
    mine = queries.op4_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert mine.astype(str).equals(want[mine.columns].astype(str))


def test_oracle_names():
    assert set(queries.ORACLE_SQL) == {"op2_minhash_neardup", "op4_mixing", "op9_substring_dedup"} <= set(queries.QUERIES)
