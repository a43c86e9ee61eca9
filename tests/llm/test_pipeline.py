"""The pipeline against brute-force stages, each on the input it was given."""

import hashlib
import math

import corpus_pipeline as P
from pyspark.sql import functions as F

from lexloom.llm import pieces, toxicity
from tests.llm.helpers import components, words
from tests.llm.test_mixing import filled

SF = "/root/testdata/sf0.001"


def chance(model, text):
    """Toxicity by trying every entry and exception at every place."""
    folded = toxicity.fold(text)
    total = 0.0
    for at in [i for i, c in enumerate(folded) if c == " "]:
        if not any(folded.startswith(p, at) for p in model.exceptions):
            total += max([w for p, w in model.lexicon.items() if folded.startswith(p, at)], default=0.0)
    n = len(folded.split())
    x = (1.0, math.log1p(total / math.sqrt(1 + n / 400)), math.log1p(50 * total / (n + 50)))
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.curve, x))))


def copies(docs):
    """Copies of each document by targets filled one source at a time."""
    size = {d: len(words(t)) for d, t in zip(docs.doc_id, docs.text)}
    names = sorted({s for s in docs.source}, key=lambda s: (s is None, s or ""))
    per = [sum(size[d] for d, s in zip(docs.doc_id, docs.source) if s == n) for n in names]
    target = dict(zip(names, zip(per, filled(per, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]))))
    out = {}
    for d, s in zip(docs.doc_id, docs.source):
        rate = target[s][1] / target[s][0] if target[s][0] else 0.0
        draw = int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:8], 16) / 2**32
        out[d] = int(rate) + (draw < rate - int(rate))
    return out


def test_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for name, stage in P.STAGES[:-1]:
        docs = P.common.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        seen.append(docs.toPandas())
    start, tox, lines, near, mixed = seen
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), P._labels(spark, SF))
    bad = {d for d, t in zip(start.doc_id, start.text) if chance(model, t) >= 0.5}
    assert sorted(tox.doc_id) == sorted(set(start.doc_id) - bad) and 0 < len(bad) < len(start) / 2
    assert sorted(lines.doc_id) == sorted(tox.doc_id)
    before = dict(zip(tox.doc_id, tox.text))
    for d, t, n in zip(lines.doc_id, lines.text, lines.n_chars):
        rest = iter(before[d].split("\n"))
        assert t == before[d] or t == "" or all(x in rest for x in t.split("\n"))
        assert n == len(t)
    want = components(list(zip(lines.doc_id, lines.text)))
    assert sorted(near.doc_id) == sorted(d for d, c in want.items() if d == c)
    assert dict(mixed.doc_id.value_counts()) == {d: n for d, n in copies(near).items() if n}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    out = P.STAGES[-1][1](spark, docs, SF).toPandas()
    text = dict(zip(mixed.doc_id, mixed.text))
    assert len(out) == len(mixed) and out.round_trip.all()
    assert all(list(i) == sp.encode(text[d]) for d, i in zip(out.doc_id, out.ids))


def test_run_and_contract(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    assert {"doc_id", "ids"} <= set(P.run(spark, SF).columns)


def test_nulls_and_further_columns(spark):
    rows = [(1, None, None, None, None, 7), (None, "a b c\nd e f", "en", "s", 11, 7), (2, "", "en", None, 0, 7), (2, "", "en", None, 0, 7), (3, "x y z " * 30, None, "s", 180, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = P.common.materialize(docs, "t")
    assert P.STAGES[-1][1](spark, docs, SF).where(~F.col("round_trip")).count() == 0
    empty = docs.where("false")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF) if empty.columns[0] == "doc_id" else empty
        assert empty.count() == 0
