"""String functions as Column builders; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.analyzer import ngrams_of

_HAN = "一-鿿"


def levenshtein_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def longest_common_subsequence(a: Column, b: Column) -> Column:
    """LCS length by a dynamic programme folded inside the JVM."""
    zero = F.transform(F.concat(F.array(F.lit("")), _chars(b)), lambda _: F.lit(0))

    def row(old: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.when(F.get(_chars(b), j) == x, F.get(old, j) + 1).otherwise(F.greatest(F.get(old, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        size = F.char_length(b)
        steps = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.array(F.lit(0)), cell)

    return F.when(a.isNotNull() & b.isNotNull(), F.element_at(F.aggregate(_chars(a), zero, row), -1))


def similarity_score(a: Column, b: Column) -> Column:
    """Best of edit similarity, character-set Jaccard and LCS share; in [0, 1]."""
    longest = F.greatest(F.char_length(a), F.char_length(b)).cast("double")
    x, y = F.array_distinct(_chars(a)), F.array_distinct(_chars(b))
    best = F.greatest(
        1.0 - F.levenshtein(a, b) / longest,
        F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double"),
        longest_common_subsequence(a, b) / longest,
    )
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(best)


def has_prefix(s: Column, prefix: Column) -> Column:
    return F.startswith(s, prefix)


def has_suffix(s: Column, suffix: Column) -> Column:
    return F.endswith(s, suffix)


def contains_substring(s: Column, pattern: Column) -> Column:
    """True for an empty pattern."""
    return F.contains(s, pattern)


def contains_any_substring(s: Column, patterns: Column) -> Column:
    """0-based indexes of the patterns that the text holds."""
    at = F.transform(patterns, lambda p, i: F.when(F.contains(s, p), i))
    return F.filter(at, lambda i: i.isNotNull())


def is_chinese_char(c: Column) -> Column:
    return c.rlike(f"^[{_HAN}]$")


def count_chinese_chars(s: Column) -> Column:
    return F.char_length(F.regexp_replace(s, f"[^{_HAN}]", ""))


def extract_chinese_segments(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"[{_HAN}]+"), F.lit(0))


def generate_ngrams(s: Column, n: int) -> Column:
    """Character n-grams, duplicates kept; empty if the text is too short or n < 1."""
    return generate_ngrams_range(s, n, n)


def generate_ngrams_range(s: Column, low: int, high: int) -> Column:
    if high < max(low, 1):
        return F.array().cast("array<string>")
    return ngrams_of(s, max(low, 1), high)


def normalize_ws(s: Column) -> Column:
    """Lower case, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def fast_hash(s: Column) -> Column:
    """A 64-bit hash; equal texts agree, values are this library's own."""
    return F.xxhash64(s)


def fast_hash32(s: Column) -> Column:
    return F.hash(s)
