"""Text analysis as Catalyst expressions, and the same rules in plain Python.

ASCII text splits at anything but letters, digits and underscore.  Other text
is NFKC-folded, where it holds a character that this may change, and cut in words: CJK characters stand alone, and letters, marks
and digits join, with a few marks allowed between two letters or two digits.
Terms of a document are its distinct tokens plus the n-grams of its CJK runs.

Cases: null texts have no tokens; fields keep apart through ``BOUNDARY``, which
is never a term, doubled, leading or trailing.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_TERM, MAX_CJK = 2, 4
BOUNDARY = "\x1e"
CJK = "㐀-䶿一-鿿豈-﫿぀-ゟ゠-ヿㇰ-ㇿ가-힯"
_LETTER = rf"[a-z\p{{L}}&&[^{CJK}]]"
_IN_WORD = rf"[a-z0-9_[\p{{L}}\p{{N}}\p{{M}}&&[^{CJK}]]]"
#: A CJK character, or word characters that hold a letter or digit, across marks
#: between two letters or two digits.  Runs are possessive: nothing backtracks.
WORDS = (
    rf"[{CJK}]|(?=[\p{{M}}_]*+[a-z0-9[\p{{L}}\p{{N}}&&[^{CJK}]]]){_IN_WORD}++"
    rf"(?:(?:(?<={_LETTER})['.:’·](?={_LETTER})|(?<=\p{{N}})[.,;'’](?=\p{{N}})){_IN_WORD}++)*+"
)
_IS_CJK = re.compile(f"[{CJK}]")
_RUNS = re.compile(f"[{CJK}]+")


#: Common characters that NFKC leaves as they are next to any other of them: none is
#: decomposed, reordered or joined to the one before it.
_INERT = (
    (0x0, 0x9F), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x180, 0x1C3), (0x1F4, 0x2AF),
    (0x4E00, 0x9FFF), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A0, 0x30FE), (0xAC00, 0xD7A3), (0x3400, 0x4DBF), (0x388, 0x3CF), (0x400, 0x482), (0x48A, 0x556), (0x5D0, 0x5EA), (0x620, 0x64A), (0x660, 0x66F),
    (0x904, 0x93B), (0xE01, 0xE32), (0x1E00, 0x1E99), (0x200B, 0x2010), (0x2012, 0x2016), (0x2018, 0x2023), (0x2030, 0x2032), (0x20A0, 0x20A7), (0x20A9, 0x20BF), (0x2190, 0x222B), (0x2500, 0x27BF), (0x1F300, 0x1F6FF),
)
_FOLDED = "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _INERT) + "]"
#: Texts that a worker holds as Python strings at once.
_FOLD_ROWS = 256


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    def fold(t: str | None) -> str | None:
        return t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)

    parts = [pa.array([fold(t) for t in texts.slice(i, _FOLD_ROWS).to_pylist()], texts.type) for i in range(0, len(texts), _FOLD_ROWS)]
    return pa.concat_arrays(parts) if parts else texts


def is_ascii(text: Column) -> Column:
    """One byte a character."""
    return F.octet_length(text) == F.char_length(text)


def is_cjk(char: Column) -> Column:
    return char.rlike(f"^[{CJK}]$")


def normalize(text: Column, nfkc: bool = True) -> Column:
    """Per-character lower case after NFKC; only rows that NFKC may change leave the JVM."""
    folded = F.coalesce(_nfkc(F.when(~is_ascii(text) & text.rlike(_FOLDED), text)), text) if nfkc else text
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.lower(F.translate(folded, "Σ", "σ")))


def ascii_tokens(normalized: Column, min_term: int = MIN_TERM) -> Column:
    return F.regexp_extract_all(normalized, F.lit(f"[a-z0-9_]{{{max(min_term, 1)},}}+"), F.lit(0))


def unicode_tokens(normalized: Column, min_term: int = MIN_TERM) -> Column:
    found = F.regexp_extract_all(normalized, F.lit(WORDS), F.lit(0))
    return found if min_term <= 1 else F.filter(found, lambda x: (F.char_length(x) >= min_term) | is_cjk(x))


def tokens(normalized: Column, min_term: int = MIN_TERM) -> Column:
    """Positional tokens of normalized text; never null."""
    either = F.when(is_ascii(normalized), ascii_tokens(normalized, min_term)).otherwise(unicode_tokens(normalized, min_term))
    return F.coalesce(either, F.array().cast("array<string>"))


def ngrams_of(run: Column, low: Column | int, high: Column | int) -> Column:
    """All character n-grams of one string for n in [low, high], shortest first."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    size = F.char_length(run)
    top = F.least(high, size)
    sizes = F.when(top >= low, F.sequence(low, top)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(run, i, n))))


def cjk_grams(normalized: Column, max_cjk: int = MAX_CJK) -> Column:
    """Terms, not tokens, of every maximal CJK run (n from 2: single ones are tokens)."""
    runs = F.regexp_extract_all(normalized, F.lit(f"[{CJK}]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: ngrams_of(r, 2, max_cjk)))
    return F.when(~is_ascii(normalized) & normalized.rlike(f"[{CJK}]{{2}}"), F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def analyze(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", min_term: int = MIN_TERM, max_cjk: int = MAX_CJK, nfkc: bool = True) -> DataFrame:
    """``doc_id, tokens, grams, dl`` of documents with one or more text fields.

    Narrow: one projection, no shuffle.  ``dl`` counts tokens, not boundaries.
    """
    norm = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *[normalize(F.coalesce(F.col(c).cast("string"), F.lit("")), nfkc).alias(f"_f{i}") for i, c in enumerate(columns)])
    fields = norm.select("doc_id", *[tokens(F.col(f"_f{i}"), min_term).alias(f"_t{i}") for i in range(len(columns))],
                         F.array_distinct(F.concat(*[cjk_grams(F.col(f"_f{i}"), max_cjk) for i in range(len(columns))])).alias("grams"))
    if len(columns) == 1:
        joined = F.col("_t0")
    else:
        filled = F.filter(F.array(*[F.col(f"_t{i}") for i in range(len(columns))]), lambda t: F.size(t) > 0)
        joined = F.flatten(F.transform(filled, lambda t, i: F.when(i > 0, F.concat(F.array(F.lit(BOUNDARY)), t)).otherwise(t)))
    return fields.select("doc_id", joined.alias("tokens"), "grams").withColumn("dl", F.size(F.filter("tokens", lambda t: t != BOUNDARY)).cast("int"))


def terms(analyzed: DataFrame) -> Column:
    """Sorted distinct terms of an analyzed document."""
    return F.array_sort(F.array_distinct(F.concat(F.filter("tokens", lambda t: t != BOUNDARY), F.col("grams"))))


# ---- the same rules on the driver, for query literals and single documents


def py_normalize(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c.lower() for c in unicodedata.normalize("NFKC", text))


def _py_words(text: str) -> list[str]:
    kind = [unicodedata.category(c)[0] for c in text]
    cjk = [bool(_IS_CJK.match(c)) for c in text]
    out: list[str] = []
    word = ""
    for i, c in enumerate(text):
        if cjk[i]:
            out.extend(filter(None, [word, c]))
            word = ""
            continue
        joins = kind[i] in "LNM" or c == "_"
        if not joins and word and 0 < i < len(text) - 1:
            a, b = (kind[i - 1], cjk[i - 1]), (kind[i + 1], cjk[i + 1])
            joins = (c in "'.:’·" and a == b == ("L", False)) or (c in ".,;'’" and a[0] == b[0] == "N")
        if joins:
            word += c
        else:
            out.extend(filter(None, [word]))
            word = ""
    return [*out, word] if word else out


def py_tokens(text: str | None, min_term: int = MIN_TERM) -> list[str]:
    norm = py_normalize(text or "")
    if norm.isascii():
        return [w for w in re.split("[^a-z0-9_]+", norm) if len(w) >= max(min_term, 1)]
    return [w for w in _py_words(norm) if _IS_CJK.fullmatch(w) or (len(w) >= min_term and any(unicodedata.category(c)[0] in "LN" for c in w))]


def py_grams(text: str | None, max_cjk: int = MAX_CJK) -> list[str]:
    out: dict[str, None] = {}
    for run in _RUNS.findall(py_normalize(text or "")):
        for n in range(2, min(max_cjk, len(run)) + 1):
            out.update(dict.fromkeys(run[i : i + n] for i in range(len(run) - n + 1)))
    return list(out)


def py_analyze(values: list[str | None], min_term: int = MIN_TERM, max_cjk: int = MAX_CJK) -> tuple[list[str], list[str], int]:
    """(tokens, grams, dl) of the fields of one document."""
    out: list[str] = []
    grams: dict[str, None] = {}
    size = 0
    for v in values:
        own = py_tokens(v, min_term)
        size += len(own)
        out.extend([BOUNDARY, *own] if out and own else own)
        grams.update(dict.fromkeys(py_grams(v, max_cjk)))
    return out, list(grams), size


def py_query(query: str, min_term: int = MIN_TERM, max_cjk: int = MAX_CJK) -> tuple[list[str], list[str], bool]:
    """(distinct terms, positional tokens, is phrase) of a query string.

    A query is a phrase only if all of it stands in double quotes.
    """
    q = query.strip()
    phrase = len(q) >= 2 and q[0] == q[-1] == '"'
    q = q[1:-1] if phrase else q
    positional = py_tokens(q, min_term)
    return sorted({*positional, *py_grams(q, max_cjk)}), positional, phrase


def levenshtein(left: str, right: str, most: int | None = None) -> int | None:
    """Edit distance by characters; None beyond ``most``."""
    row = list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        old, row = row, [i]
        for j, b in enumerate(right, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
        if most is not None and min(row) > most:
            return None
    return None if most is not None and row[-1] > most else row[-1]
