"""Steps whose moved bytes and memory grow no faster than the input."""

import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.engine import SearchEngine
from lexloom.functions import analyzer as A
from lexloom.operators import index as I
from lexloom.operators import search as S
from lexloom.sources import store as ST

TEXTS = ["the cat of the house", "", "全文搜索 cat the the", "of the", None, "全 文 house", "the " * 50, "ﬃ Größe cat"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture()
def engine(spark, tmp_path, monkeypatch):
    """A store with superseded rows, more of them than are broadcast."""
    monkeypatch.setattr(ST, "FEW", 0, raising=False)
    e = SearchEngine(spark, EngineConfig.persistent(f"file://{tmp_path}/s"))
    e.add_frame(docs(spark), ["text"])
    e.flush()
    e.add_frame(docs(spark).where("doc_id in (0, 6)").withColumn("text", F.lit("new cat")), ["text"])
    e.flush()
    assert e.store.manifest.superseded == 2
    return e


# ---- F1, F3: postings are written without a shuffle, rows of a segment are not sorted


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_runs_hold_the_postings(monkeypatch, limit):
    monkeypatch.setattr(I, "RUN_TOKENS", limit)
    rows = [([], [], 0), (["b", "a", "b", A.BOUNDARY, "é", "a"], [], 5), (["全", "文"], ["全文"], 2), ([], [], 0), (["a"] * 9, [], 9), (["全文", "全", "文", "z"], ["全文"], 4)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": 10 + i, "seq": 3, "dl": dl, "tokens": t, "grams": g} for i, (t, g, dl) in enumerate(rows)], pa.schema(
        [("doc_id", pa.int64()), ("seq", pa.int64()), ("dl", pa.int32()), ("tokens", pa.list_(pa.string())), ("grams", pa.list_(pa.string()))]))
    out = [x.to_pylist() for x in I._runs(iter([batch, batch.slice(0, 0), batch.slice(2, 0)]))]
    want = sorted((t, 10 + i, 3, Counter(tokens)[t], dl) for i, (tokens, grams, dl) in enumerate(rows) for t in {*tokens, *grams} - {A.BOUNDARY})
    assert sorted(tuple(r.values()) for run in out for r in run) == want
    assert all([r["term"].encode() for r in run] == sorted(r["term"].encode() for r in run) for run in out)


def test_stored_postings_equal_unstored_ones_without_a_shuffle(spark, engine):
    engine.compact()
    live = engine.store.live_documents()
    assert "Exchange" not in plan(I.runs(live))
    columns = ["term", "doc_id", "tf", "dl"]
    assert sorted(engine.index().postings().select(columns).collect()) == sorted(I.postings(live.drop("seq")).select(columns).collect())


def test_superseded_rows_are_hashed_not_sorted(engine):
    live = engine.store.live_documents()
    assert "SortMergeJoin" not in plan(live) and "ShuffledHashJoin" in plan(live)
    assert sorted(r["doc_id"] for r in live.collect()) == list(range(len(TEXTS)))


# ---- F2: live terms come by the documents


def test_live_terms_need_no_postings(engine):
    terms = engine.all_terms()
    assert "/postings" not in "".join(terms.inputFiles())
    assert {r["term"] for r in terms.collect()} == {"new", "cat", "of", "the", "house", "全", "文", "搜", "索", "全文", "文搜", "搜索", "全文搜", "文搜索", "全文搜索", "ffi", "größe"}


# ---- F4: only texts that NFKC may change are folded in Python


def test_inert_characters_are_inert():
    joined = {int(d[1], 16) for c in range(0x110000) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and d[0][0] != "<"} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for a, b in A._INERT:
        for c in range(a, b + 1):
            assert unicodedata.is_normalized("NFKC", chr(c)) and not unicodedata.combining(chr(c)) and c not in joined, hex(c)


def test_only_texts_that_fold_are_sent_to_python(spark):
    texts = ["plain", "Größe Ελλάδα Привет", "全文搜索 かな 한국어", "“quoted” – text", "ﬃ", "e\u0301", "ｗｉｄｅ", "\u1100\u1161", "½"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    got = rows.select("t", F.col("t").rlike(A._FOLDED).alias("sent"), A.normalize(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["sent"] for r in got} == {t: i > 3 for i, t in enumerate(texts)}
    assert all(r["n"] == A.py_normalize(r["t"]) for r in got)


# ---- F5, F6: phrases are looked for in the documents' rows; their tokens are not joined


def test_stored_phrase_joins_nothing(engine):
    engine.compact()
    found = engine.search('"of the"').frame
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    assert [r["doc_id"] for r in found.collect()] == [3]


def test_stored_phrase_moves_no_tokens(engine):
    found = engine.search('"of the"').frame
    assert all("tokens" not in line for line in plan(found).splitlines() if "Exchange" in line)
    assert [r["doc_id"] for r in found.collect()] == [3]
    assert [h.to_list() for h in engine.search_batch(["the cat", '"of the"', '"全文"', ""])] == [[2], [3], [2], []]
    assert "tokens" not in "".join(line for line in plan(S.search_batch(engine.index(), ['"of the"'])).splitlines() if "Exchange" in line)


def test_batched_phrase_needs_all_its_terms(spark):
    """As in a single search: neighbours of two runs are not the run's gram."""
    own = I.Index.build(docs(spark), ["text"])
    assert [r["doc_id"] for r in S.search(own, '"全文"').collect()] == [2]
    assert [tuple(r) for r in S.search_batch(own, ['"全文"']).collect()] == [(0, 2)]
