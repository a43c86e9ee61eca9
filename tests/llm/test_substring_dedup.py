import numpy as np
import pytest

from lexloom.llm import fmindex, substring_dedup as S
from tests.llm.helpers import NASTY, corpus, repeats


def result(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.dedup(df, **how).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=str)


@pytest.mark.parametrize("window, hot", [(35, 16_384), (12, 16_384), (12, 2)])
def test_equals_brute_force(spark, window, hot):
    rows = corpus(1) + NASTY
    assert result(spark, rows, window=window, hot=hot, shard_segments=20) == sorted(repeats(rows, window), key=str)


def test_periods_and_passage_edges(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (2, "x " + " ".join(f"w{i}" for i in range(10, 44)) + " y"), (3, "p " + " ".join(f"w{i}" for i in range(10, 45)) + " q"),
            (4, "a b " * 60), (5, "c d e " * 12), (6, "f " * 36), (7, "g " * 35)]
    assert result(spark, rows) == sorted(repeats(rows, 35), key=str)


def test_empty_table_and_window_bounds(spark):
    assert result(spark, []) == []
    with pytest.raises(ValueError):
        S.dedup(spark.createDataFrame([], "doc_id long, text string"), window=70)


def test_hot_passage_in_many_surroundings(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(120)]
    for hot in (16_384, 10):
        assert all(n == 50 for _, _, n, _ in result(spark, rows, hot=hot))


def test_fm_index_against_scan():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 3, 60)
    first = np.array([0, 20, 45, 60])
    fm = fmindex.FMIndex(text, first)
    seqs = [text[a:b].tolist() for a, b in zip(first, first[1:])]
    for n in range(1, 6):
        for _ in range(20):
            p = rng.integers(0, 3, n).tolist()
            lo, hi = np.array([0]), np.array([fm.n])
            for c in reversed(p):
                lo, hi = fm.extend(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum(s[i : i + n] == p for s in seqs for i in range(len(s) - n + 1))


def test_wavelet_matrix_rank():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 37, 500)
    w = fmindex.WaveletMatrix(s, 37)
    c, i = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert w.rank(c, i).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, i)]
