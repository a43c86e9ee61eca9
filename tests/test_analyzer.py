from pyspark.sql import functions as F
import pytest

from lexloom.functions import analyzer as A

CASES = {
    "Hello World": ["hello", "world"],
    "don't stop": ["don", "stop"],
    "don’t v2.0.1 a.b.c it's naïve e.g. 3,14": ["don’t", "v2.0.1", "a.b.c", "it's", "naïve", "e.g", "3,14"],
    "Hello你好World世界": ["hello", "你", "好", "world", "世", "界"],
    "2.0.1": [],
    "é 2.0.1 x": ["2.0.1"],
    "snake_case __ é __": ["snake_case"],
    "__ ascii": ["__", "ascii"],
    "Ｆｕｌｌ　Ｗｉｄｔｈ": ["full", "width"],
    "ΣΑΣ": ["σασ"],
    "": [],
    " \t\n": [],
    "example.com and café": ["example.com", "and", "café"],
    "example.com": ["example", "com"],
    "한국어 테": ["한", "국", "어", "테"],
    "a1:b2 x:y é": ["a1", "b2", "x:y"],
    None: [],
}


def test_column_and_driver_analyzers_agree(spark):
    rows = [(i, t) for i, t in enumerate(CASES)]
    got = {r["doc_id"]: r for r in A.analyze(spark.createDataFrame(rows, "doc_id long, t string"), ["t"]).collect()}
    for i, t in rows:
        tokens, grams, size = A.py_analyze([t])
        assert got[i]["tokens"] == tokens == CASES[t], t
        assert sorted(got[i]["grams"]) == sorted(grams), t
        assert got[i]["dl"] == size == len(tokens)


def test_corpus_parity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in A.analyze(docs, ["text"]).join(docs, "doc_id").collect():
        assert r["tokens"] == A.py_tokens(r["text"])


def test_cjk_grams_are_terms_not_tokens(spark):
    d = A.analyze(spark.createDataFrame([(1, "全文搜索 ab")], "doc_id long, t string"), ["t"], max_cjk=3)
    r = d.select(A.terms(d).alias("terms"), "tokens").first()
    assert r["tokens"] == ["全", "文", "搜", "索", "ab"]
    assert set(r["terms"]) == {"ab", "全", "文", "搜", "索", "全文", "文搜", "搜索", "全文搜", "文搜索"}
    assert r["terms"] == sorted(r["terms"], key=lambda t: t.encode())


def test_boundaries_keep_fields_apart(spark):
    rows = [(1, "quick", "brown fox"), (2, "", "quick brown"), (3, None, None), (4, "quick", "!!")]
    d = A.analyze(spark.createDataFrame(rows, "doc_id long, a string, b string"), ["a", "b"])
    got = {r["doc_id"]: (r["tokens"], r["dl"]) for r in d.collect()}
    assert got == {1: (["quick", A.BOUNDARY, "brown", "fox"], 3), 2: (["quick", "brown"], 2), 3: ([], 0), 4: (["quick"], 1)}
    assert A.py_analyze(["quick", "brown fox"])[0] == got[1][0]


def test_min_term_length_spares_cjk():
    assert A.py_tokens("ab abc 你", 3) == ["abc", "你"]


@pytest.mark.parametrize("query, expected", [
    ('"quick brown"', (["brown", "quick"], ["quick", "brown"], True)),
    ("quick quick", (["quick"], ["quick", "quick"], False)),
    ('say "quick brown"', (["brown", "quick", "say"], ["say", "quick", "brown"], False)),
    ("  ", ([], [], False)), ('""', ([], [], True)), ('"', ([], [], False)),
])
def test_query_parsing(query, expected):
    assert A.py_query(query) == expected


def test_levenshtein():
    assert A.levenshtein("kitten", "sitting") == 3
    assert A.levenshtein("kitten", "sitting", 2) is None
    assert A.levenshtein("", "ab") == 2
    assert A.levenshtein("same", "same", 0) == 0


def test_tokens_stay_in_the_jvm_without_folding(spark):
    d = A.analyze(spark.createDataFrame([(1, "a")], "doc_id long, t string"), ["t"], nfkc=False)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
