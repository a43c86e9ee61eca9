import random

import numpy as np

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lexloom.llm import pieces as P, sentencepiece_lattice as S, token_counts as C
from tests.llm.helpers import NASTY, corpus


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


def weird(n=150):
    r = random.Random(4)
    alphabet = " \n\t\r abcdeABC.,!?-_'\"0123456789éßñ世界🙂▁　\xa0"
    return [(1000 + i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("table, cache", [(S.TABLE_ROWS, S.CACHE_ROWS), (0, 10), (50, 0)])
def test_ids_equal_the_library(spark, sp, table, cache):
    rows = corpus(5, 20) + NASTY + weird()
    got = S.encode(spark.createDataFrame(rows, "doc_id long, text string"), table_rows=table, cache_rows=cache).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r["ids"]) == sp.encode(r["text"] or ""), repr(r["text"])
        assert r["n_pieces"] == len(r["ids"]) and r["round_trip"]


def test_decoding_round_trip(spark, sp):
    rows = [r for r in corpus(6, 10) + NASTY + weird(40) if r[1] is not None]
    enc = S.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in S.decode(enc).collect():
        assert r["decoded"] == r["text"].replace("▁", " ")
        assert r["decoded"] == sp.decode(list(r["ids"]))


def test_decoding_cases(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 13, None])], "i int, ids array<int>")
    got = {r["i"]: r["decoded"] for r in S.decode(df).collect()}
    assert got[1] is None and got[2] == "" and isinstance(got[3], str)


def test_lattice_fold_equals_brute_force_merges(spark):
    rank = S.ranks(P.model_path())
    r = random.Random(9)
    pool = [p for p in rank if len(p) > 2]
    words = sorted({"▁" + "".join(r.choice(pool).strip("▁") for _ in range(r.randint(1, 4))) for _ in range(400)} | {"a", "ab", "▁" * 9 + "x", "aaaaaaaaaaaa", "世界"})
    words = [w for w in words if len(w) <= S.MAX_CHARS]
    got = {x["word"]: x["chosen"] for x in S.encode_words(spark.createDataFrame([(w,) for w in words], "word string").repartition("word"), P.model_path()).collect()}
    assert set(got) == set(words)
    for w in words:
        spans = {(e >> S._START) & 63: (e >> S._LENGTH) & 63 for e in got[w]}
        parts, k = [], 0
        while k < len(w):
            parts.append(w[k : k + spans.get(k, 1)])
            k += spans.get(k, 1)
        assert parts == S.merge_order(w, rank)[0], w
    assert not any(v is None for v in got.values()) and not S.risky(P.model_path())


def test_grouping_edges_adds_no_shuffle(spark):
    words = spark.createDataFrame([("ab",)], "word string").repartition("word")
    plan = S.encode_words(words, P.model_path())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_viterbi_against_all_segmentations(spark):
    r = random.Random(2)
    table = [("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -3.1), ("aba", -5.5), ("bb", -4.9), ("abab", -7.2)]
    score = dict(table)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(60)})

    def best(w):
        if not w:
            return 0.0
        return max(score.get(w[:k], -1e3 if k == 1 else -1e18) + best(w[k:]) for k in range(1, len(w) + 1))

    got = S.viterbi(spark.createDataFrame([(w,) for w in [*words, ""]], "word string"), spark.createDataFrame(table, "piece string, score double")).collect()
    assert {g["word"] for g in got} == set(words)
    for g in got:
        assert "".join(g["pieces"]) == g["word"]
        assert abs(g["score"] - best(g["word"])) < 1e-9
        assert abs(sum(score.get(p, -1e3) for p in g["pieces"]) - g["score"]) < 1e-9


@pytest.mark.parametrize("table, cache", [(C.TABLE_ROWS, C.CACHE_ROWS), (0, 5), (20, 0)])
def test_token_counts_equal_the_library(spark, sp, table, cache):
    rows = corpus(7, 20) + NASTY + weird()
    got = C.count(spark.createDataFrame(rows, "doc_id long, text string"), table_rows=table, cache_rows=cache).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(sp.encode(t))) and r["over_limit"] == (r["n_tokens"] > 4096)


def test_empty_tables_and_clashing_columns(spark, sp):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.encode(empty).count() == 0 and C.count(empty).count() == 0
    df = spark.createDataFrame([("hello", 5, "x")], "text string, n_tokens int, ids string")
    assert C.count(df).first()["n_tokens"] == len(sp.encode("hello"))
    assert S.encode(df).select(F.size("ids").alias("n")).first()["n"] == len(sp.encode("hello"))


def test_worker_lattice_equals_the_library(sp):
    """Units of any length, spaces and characters, in one batch."""
    r = random.Random(11)
    pool = [p.replace("▁", "") for p in S.ranks(P.model_path()) if len(p) > 1]
    units = [(r.choice([0, 1, 1, 1, 2, 7, 40]), "".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for _ in range(3000)]
    units += [(1, "x" * 3000), (1, "ab" * 700), (3, "世界🙂é\x00"), (1, "а" * 200), (0, "a"), (1, "".join(chr(r.randrange(33, 0x2FFF)) for _ in range(500)).replace("▁", ""))]
    units = [(k, w) for k, w in units if w and " " not in w and "\n" not in w]
    data = [w.encode() for _, w in units]
    ends = np.cumsum([len(d) for d in data])
    buf = np.frombuffer(b"".join(data) + b"\0" * 8, np.uint8)
    ids, count = S.lattice(P.model_path()).encode(buf, ends - [len(d) for d in data], ends, np.array([k for k, _ in units]))
    cut = np.r_[0, np.cumsum(count)]
    want = P.encode_units(P.model_path(), units)
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == want
    encoder = S.Encoder(P.model_path(), S.Ids(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)))
    assert all(encoder.run(k).tolist() == list(P.run_ids(P.model_path(), k)) for k in [*range(1, 80), 300])
    assert encoder.line.tolist() == [sp.encode("\n\n")[-1]]


def test_workers_give_free_memory_back(tmp_path):
    """What earlier steps left in a worker's heap goes when encoding starts, and large arrays go when freed."""
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "worker.py"
    script.write_text("""
import re
import numpy as np
from lexloom.llm import textnp as X
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
start = held()
parts = [np.ones(100_000, np.uint8) for _ in range(2_000)]
del parts[:-1]
X.lean()
print(held() - start)
pin = []
for _ in range(30):
    a = np.ones(4 << 20, np.uint8)
    pin.append(np.ones(90_000, np.uint8))
    del a
print(held() - start)
""")
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, cwd=root, env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"})
    assert all(float(x) < 40 for x in out.stdout.split()) and len(out.stdout.split()) == 2, out.stdout + out.stderr
