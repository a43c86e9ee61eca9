"""Input columns named like those that operators make or use inside."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann, common, line_dedup, mixing, neardup, quality, sentencepiece_lattice, substring_dedup, token_counts, toxicity, url_filter

NAMES = """_k _rows _weight _s _part _before weight row d t k h h1 h2 n w line lo hi spots spots_ __spots gone gone_ __gone _rest _rest_ _verdict key c p b r ids_ same keep bytes
    size source_size target rate copies taken copy n_lines n_removed spans tox_weight n_hits score predicted n_bytes n_tokens over_limit ids n_pieces round_trip decoded
    host path rule llr verdict n_shingles component_id kept component bands odd f1 f2 rep reps low high word_high log_ppl word_log_ppl base_failed n_words symbols
    query_id rank q v vector shard part block mh sg at cnt mask who kinds Text_ DOC_KEY""".split()  # fmt: skip


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three\nfour five six\nseven " * 9, None, "", "plain words " * 30, "plain words " * 30, "scum of all\nfour five six\nseven one two three"]
    rows = spark.createDataFrame([(i, t, "en", "s", "http://a.com/en/1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, url string")
    return rows.select("*", *[F.lit("mine").alias(n) for n in NAMES])


MODEL = toxicity.Model({" scum ": 4.0})
PASS = {
    "toxicity": (lambda d: toxicity.score(d, MODEL), toxicity.NEW),
    "mixing": (lambda d: mixing.mix(d), mixing.NEW),
    "line_dedup": (lambda d: line_dedup.dedup(d, whole_runs=True), line_dedup.NEW),
    "line_chunks": (lambda d: line_dedup.dedup(d), line_dedup.NEW),
    "keep_first": (lambda d: neardup.keep_first(d), []),
    "token_counts": (lambda d: token_counts.count(d), ["n_bytes", "n_tokens", "over_limit"]),
    "encode": (lambda d: sentencepiece_lattice.encode(d, table_rows=10), ["ids", "n_pieces", "round_trip"]),
    "url_filter": (lambda d: url_filter.judge(d), ["host", "path", "rule", "llr", "verdict"]),
}


@pytest.mark.parametrize("name", PASS)
def test_further_columns_pass_through(docs, name):
    run, new = PASS[name]
    got = run(docs)
    rows = got.collect()
    assert set(docs.columns) | set(new) == set(got.columns) and len(got.columns) == len(set(got.columns))
    assert len(rows) == (5 if name == "keep_first" else 6)
    assert all(r[c] == "mine" for r in rows for c in NAMES if c not in new)


@pytest.mark.parametrize("run", [neardup.near_duplicates, quality.judge, substring_dedup.dedup])
def test_own_columns_only(docs, run):
    assert run(docs).count() == 6


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<float>").select("*", *[F.lit("mine").alias(n) for n in NAMES])
    assert ann.search(rows, F.col("vec_id") == 0).count() == 3


def test_pipeline_keeps_them_all(spark, docs):
    own = docs
    for _, stage in P.STAGES[:-1]:
        own = common.materialize(stage(spark, own, "/root/testdata/sf0.001"), "t")
        assert own.columns == docs.columns
        assert own.where(" or ".join(f"`{n}` <> 'mine'" for n in NAMES)).isEmpty() and not own.isEmpty()
    out = P.STAGES[-1][1](spark, own, "")
    assert set(docs.columns) - {"text"} <= set(out.columns) and out.count() == own.count()
