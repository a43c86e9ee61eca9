from pyspark.sql import functions as F

from lexloom.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


def score(a, b):
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    from lexloom.functions.analyzer import levenshtein

    n = max(len(a), len(b))
    return max(1 - levenshtein(a, b) / n, len(set(a) & set(b)) / len(set(a) | set(b)), lcs(a, b) / n)


def test_lcs_and_similarity_by_brute_force(spark):
    words = ["", "a", "ABCDGH", "AEDFHR", "hello", "help", "世界你好", "你好", "🙂ab🙂"]
    rows = [(a, b) for a in words for b in words] + [(None, "a")]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", X.longest_common_subsequence(a, b).alias("l"), X.similarity_score(a, b).alias("s")).collect()
    for r in got:
        if r["a"] is None:
            assert r["l"] is None
            continue
        assert r["l"] == lcs(r["a"], r["b"]), r
        assert abs(r["s"] - score(r["a"], r["b"])) < 1e-12, r


def test_registered_lcs_queries(spark):
    from lexloom.plans import catalog

    for r in catalog.lcs(spark, "/root/testdata/sf0.001").collect():
        assert r["lcs"] == lcs(r["a"], r["b"])
    for r in catalog.similarity(spark, "/root/testdata/sf0.001").collect():
        assert abs(r["score"] - score(r["a"], r["b"])) < 1e-6


def test_ngrams(spark):
    s = F.lit("hello")
    assert one(spark, X.generate_ngrams(s, 2)) == ["he", "el", "ll", "lo"]
    assert one(spark, X.generate_ngrams(s, 6)) == []
    assert one(spark, X.generate_ngrams(s, 0)) == []
    assert one(spark, X.generate_ngrams_range(F.lit("abc"), 1, 2)) == ["a", "b", "c", "ab", "bc"]
    assert one(spark, X.generate_ngrams_range(F.lit("abc"), 3, 2)) == []


def test_contains(spark):
    patterns = F.array(F.lit("b"), F.lit("x"), F.lit(""))
    assert one(spark, X.contains_any_substring(F.lit("abc"), patterns)) == [0, 2]
    assert one(spark, X.contains_substring(F.lit("abc"), F.lit(""))) is True
    assert one(spark, X.has_prefix(F.lit("abc"), F.lit("ab"))) and one(spark, X.has_suffix(F.lit("abc"), F.lit("bc")))


def test_chinese(spark):
    s = F.lit("hello中文world字")
    assert one(spark, X.count_chinese_chars(s)) == 3
    assert one(spark, X.extract_chinese_segments(s)) == ["中文", "字"]
    assert one(spark, X.is_chinese_char(F.lit("中"))) and not one(spark, X.is_chinese_char(F.lit("a")))


def test_normalize_and_hashes(spark):
    assert one(spark, X.normalize_ws(F.lit("  A\t b\n\nC "))) == "a b c"
    assert one(spark, X.fast_hash(F.lit("a"))) == one(spark, X.fast_hash(F.lit("a"))) != one(spark, X.fast_hash(F.lit("b")))
    assert one(spark, X.fast_hash32(F.lit("a"))) != one(spark, X.fast_hash32(F.lit("b")))
