"""Op 8: URL verdicts by rules, else by a character language-model ratio.

Two smoothed variable-order Markov models (Witten-Bell back-off) are counted over
every URL that a rule accepts or rejects.  A URL without a rule is judged by the
length-normalised log-likelihood difference of the two models, against a
threshold calibrated on all rule-labelled URLs, each scored by counts that left
out its fold.  Contexts are 1 to ``RAW`` exact bytes (digits and UTF-8 bytes as
they are), whatever the size of the input; below them a folded model of ``A``
symbols and order 3 is the base.

The tables grow with the URLs and are never gathered.  A byte and the ``RAW`` before
it are one *gram*, packed into a long; it fixes all lower orders.  Distinct URLs are
dealt to chunks, a chunk sends each of its distinct grams once with its counts, grams
meet by the last two bytes of their context, are given their log-ratios there, and go
back to the chunks that asked.  Only the folded cells (``A^4`` at most) and order 1
(257 x 258 rows at most) are broadcast.  Counts are whole numbers, so neither
partitions nor chunks change a result.

Cases: a null URL or one without ``://`` has an empty host and path, fits no
rule and is judged as an empty string; equal URLs get equal verdicts; without
rule-labelled URLs of both kinds all URLs without a rule are allowed.  URLs are
never cut; ties (a score at the threshold) are allowed.  Further columns pass
through, except those named like an output column, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import common as C
from lexloom.llm import textnp as X

#: (verdict, host, path); hosts fit all their subdomains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_SYMBOLS = "./-_?=&#%~:+"
START, END, OTHER, DIGIT = 26 + len(_SYMBOLS), 27 + len(_SYMBOLS), 28 + len(_SYMBOLS), 29 + len(_SYMBOLS)
A = DIGIT + 1
ORDER = 3
CODE = np.full(256, OTHER, np.int64)
CODE[48:58] = DIGIT
CODE[97:123] = np.arange(26)
CODE[65:91] = np.arange(26)
for _k, _c in enumerate(_SYMBOLS):
    CODE[ord(_c)] = 26 + _k
_BINS, _SPAN = 400, 4.0
#: Bytes of context in a gram; symbols behind and before a URL; bits of a byte and of a folded symbol in a packed key.
FOLDS, RAW, RAW_END, RAW_START, RAW_BITS, BITS = 3, 6, 256, 257, 9, 6
#: Bytes of URLs a chunk, and grams a partition.
CHUNK_BYTES, PART_GRAMS = 1 << 18, 500_000
CLASS = np.bincount(CODE, minlength=A)  # bytes of each symbol
CLASS[[START, END]] = 1
_COUNTS = [f"n{x}" for x in range(2 * FOLDS)]  # of fold and kind (1: accepted)
_RATIOS = [f"r{x}" for x in range(FOLDS + 1)]  # by all counts, and without those of each fold


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and everything behind ``://`` (all empty without it)."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    empty = F.lit("")
    return (
        F.coalesce(F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower()), empty),
        F.coalesce(F.regexp_extract(url, pattern, 2), empty),
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), empty),
    )


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def codes(off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-gram cell of every symbol (an end mark closes each row), and rows."""
    n = np.diff(off)
    rows = np.repeat(np.arange(len(n)), n + ORDER + 1)
    out = np.full(len(rows), START, np.int64)
    base = np.cumsum(n + ORDER + 1) - (n + ORDER + 1)
    inside = np.repeat(base + ORDER - off[:-1], n) + np.arange(off[-1])
    out[inside] = CODE[buf[: off[-1]]]
    out[base + ORDER + n] = END
    cell = np.zeros(len(out), np.int64)
    for k in range(ORDER + 1):
        cell[ORDER:] = cell[ORDER:] * A + out[k : len(out) - ORDER + k]
    keep = np.ones(len(out), bool)
    for k in range(ORDER):
        keep[base + k] = False
    return cell[keep], rows[keep]


def probabilities(counts: np.ndarray) -> np.ndarray:
    """log P of each cell, by Witten-Bell from the uniform distribution up."""
    p = np.full(A, 1.0 / A)
    for k in range(ORDER + 1):
        n = counts.reshape(-1, A**k, A).sum(axis=0)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, A), (A**k // max(1, p.reshape(-1, A).shape[0]), 1)) if k else p.reshape(1, A)
        p = np.where(total > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(p.reshape(-1))


def raw_order(n_bytes: int) -> int:
    """Longest context worth for so many labelled bytes; the models don't depend on it (``RAW``)."""
    return max(ORDER, round(math.log(max(n_bytes, 1), 16)))


def grams(off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed gram of every symbol (an end mark closes each row), oldest byte first, and rows."""
    n = np.diff(off)
    size = n + RAW + 1
    base = np.cumsum(size) - size
    out = np.full(int(size.sum()), RAW_START, np.int64)
    out[np.repeat(base + RAW - off[:-1], n) + np.arange(off[-1])] = buf[: off[-1]]
    out[base + RAW + n] = RAW_END
    rows = np.repeat(np.arange(len(n)), n + 1)
    at = np.arange(len(rows)) + RAW * (rows + 1)
    key = np.zeros(len(at), np.int64)
    for k in range(RAW, -1, -1):
        key = (key << RAW_BITS) | out[at - k]
    return key, rows


def folded(key: np.ndarray) -> np.ndarray:
    """Packed folded symbols of a gram's last ``ORDER`` + 1 bytes."""
    fold = np.r_[CODE, END, START]
    cell = np.zeros(len(key), np.int64)
    for k in range(ORDER, -1, -1):
        cell = (cell << BITS) | fold[(key >> (RAW_BITS * k)) & ((1 << RAW_BITS) - 1)]
    return cell


def variants(n: np.ndarray) -> np.ndarray:
    """Counts of each model (all, and without each fold; of rejected, then of accepted) from those of fold and kind."""
    both = [n[:, kind::2] for kind in (0, 1)]
    return np.concatenate([np.c_[x.sum(axis=1), x.sum(axis=1, keepdims=True) - x] for x in both], axis=1)


class Level:
    """Witten-Bell counts of one order: keys end in the symbol, ``bits`` wide, behind its context."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bits: int):
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        self.keys, self.n = s[first], np.add.reduceat(n[order], first)
        above = self.keys >> bits
        new = np.r_[True, above[1:] != above[:-1]]
        self.context, first = np.cumsum(new) - 1, np.flatnonzero(new)
        n = variants(self.n)
        self.total, self.kinds = np.add.reduceat(n, first), np.add.reduceat((n > 0).astype(np.int64), first)

    def over(self, lower: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Probabilities of ``keys`` (all of which are held) in every model, given those of the order below."""
        slot = np.searchsorted(self.keys, keys)
        total, kinds = self.total[self.context[slot]], self.kinds[self.context[slot]]
        return np.where(total > 0, (variants(self.n[slot]) + kinds * lower) / np.maximum(total + kinds, 1), lower)


def base(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probabilities of distinct folded cells in every model, from the uniform distribution up."""
    p = np.full((len(cells), 2 * (FOLDS + 1)), 1.0 / A)
    for k in range(ORDER + 1):
        own = cells & ((1 << (BITS * (k + 1))) - 1)
        p = Level(own, n, BITS).over(p, own)
    return p / CLASS[cells & ((1 << BITS) - 1)][:, None]


def log_ratios(key: np.ndarray, n: np.ndarray, cells: np.ndarray, below: np.ndarray, first: Level, step: int = 100_000) -> np.ndarray:
    """log P(accepted) - log P(rejected) of distinct grams, by all counts and without each fold.

    ``key`` holds all grams with the contexts of two bytes that it holds.
    """
    mask = lambda k: (1 << (RAW_BITS * (k + 1))) - 1
    levels = [Level(key & mask(k), n, RAW_BITS) for k in range(2, RAW + 1)]
    out = np.empty((len(key), FOLDS + 1))
    for lo in range(0, len(key), step):
        own = key[lo : lo + step]
        p = first.over(below[np.searchsorted(cells, folded(own))], own & mask(1))
        for k, level in enumerate(levels, 2):
            p = level.over(p, own & mask(k))
        logs = np.log(p)
        out[lo : lo + step] = logs[:, FOLDS + 1 :] - logs[:, : FOLDS + 1]
    return out


def _matrix(t: pa.Table, names: list[str], kind=np.int64) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(kind) for c in names], axis=1)


def _long(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def scores(urls: DataFrame, chunk_bytes: int = CHUNK_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """``u, v, f, w, llr, held`` of distinct URLs ``u, v, f, w`` (label or null, fold, rows): ratios by all counts, and by those without the URL's fold."""
    spark = urls.sparkSession
    n_bytes = urls.agg(F.sum(F.octet_length("u"))).first()[0] or 0
    urls = urls.withColumn("c", F.pmod(F.xxhash64("u", F.lit(1)), F.lit(n_bytes // chunk_bytes + 1)))
    counts = ", ".join(f"{c} long" for c in _COUNTS)

    def ask(t: pa.Table) -> pa.Table:
        label = t.column("v").combine_chunks()
        kind = np.asarray(pa.compute.equal(label, "allow").fill_null(False)).astype(np.int64)
        part = np.where(np.asarray(label.is_valid()), _long(t, "f") * 2 + kind, -1)
        keys, found = [], []
        for lo, hi, off, buf in X.chunks(t.column("u")):
            key, row = grams(off, buf)
            own, inverse = np.unique(key, return_inverse=True)
            n = np.zeros((len(own), len(_COUNTS)), np.int64)
            at = part[lo:hi][row]
            yes = at >= 0
            np.add.at(n, (inverse[yes], at[yes]), _long(t, "w")[lo:hi][row[yes]])
            keys.append(own)
            found.append(n)
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros((len(key), len(_COUNTS)), np.int64)
        np.add.at(n, inverse, np.concatenate(found))
        return pa.table({"c": pa.array(np.full(len(key), t.column("c")[0].as_py())), "g": pa.array(key), **{c: pa.array(n[:, i]) for i, c in enumerate(_COUNTS)}})

    asked = C.materialize(urls.groupBy("c").applyInArrow(ask, f"c long, g long, {counts}"), "asked")
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    counted = C.materialize(asked.groupBy("g").agg(*sums), "grams")

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            if len(t):
                low = Level(folded(_long(t, "g")), _matrix(t, _COUNTS), BITS)
                yield pa.record_batch({"g": pa.array(low.keys), **{c: pa.array(low.n[:, i]) for i, c in enumerate(_COUNTS)}})

    gather = lambda df: df.groupBy("g").agg(*sums).orderBy("g").toPandas()
    low = gather(counted.mapInArrow(cells_of, f"g long, {counts}"))  # A^4 rows at most
    one = gather(counted.withColumn("g", F.col("g").bitwiseAND((1 << (2 * RAW_BITS)) - 1)))  # 257 x 258 rows at most
    n_parts = counted.count() // part_grams + 1
    if not len(low):
        return urls.drop("c").withColumns({"llr": F.lit(0.0), "held": F.lit(0.0)})
    cells = low.g.to_numpy()
    shared = spark.sparkContext.broadcast((cells, base(cells, low[_COUNTS].to_numpy()), Level(one.g.to_numpy(), one[_COUNTS].to_numpy(), RAW_BITS)))

    def reduce(t: pa.Table) -> pa.Table:
        key = _long(t, "g")
        found = log_ratios(key, _matrix(t, _COUNTS), *shared.value)
        return pa.table({"g": pa.array(key), **{c: pa.array(found[:, i]) for i, c in enumerate(_RATIOS)}})

    context = F.shiftright("g", RAW_BITS).bitwiseAND((1 << (2 * RAW_BITS)) - 1)
    ratios = counted.withColumn("p", F.pmod(F.xxhash64(context), F.lit(n_parts))).groupBy("p").applyInArrow(reduce, f"g long, {', '.join(f'{c} double' for c in _RATIOS)}")

    def score(t: pa.Table, r: pa.Table) -> pa.Table:
        key = _long(r, "g")
        order = np.argsort(key)
        key, found = key[order], _matrix(r, _RATIOS, np.float64)[order]
        fold, out = _long(t, "f"), []
        for lo, hi, off, buf in X.chunks(t.column("u")):
            own, row = grams(off, buf)
            slot = np.searchsorted(key, own)
            size = np.bincount(row, minlength=hi - lo)
            out.append([np.bincount(row, found[slot, at], hi - lo) / size for at in (0, fold[lo:hi][row] + 1)])
        llr, held = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        return pa.table({c: t.column(c) for c in ("u", "v", "f", "w")} | {"llr": pa.array(llr), "held": pa.array(held)})

    replies = asked.select("c", "g").join(ratios, "g").groupBy("c")
    return urls.groupBy("c").cogroup(replies).applyInArrow(score, "u string, v string, f int, w long, llr double, held double")


def learn(labelled: DataFrame, url: str, label: str, **sizes) -> tuple[DataFrame, float] | None:
    """Scores of all distinct URLs (``u, w, llr``) and the threshold; each fold is calibrated by the others' counts."""
    fold = F.pmod(F.xxhash64("u"), F.lit(FOLDS)).cast("int").alias("f")
    rows = labelled.groupBy(F.col(url).alias("u")).agg(F.first(label).alias("v"), F.count("*").alias("w"))  # the label is a function of the URL
    urls = C.materialize(rows.select("u", "v", fold, "w"), "urls")
    known = {(r["f"], r["v"]) for r in urls.where(F.col("v").isNotNull()).select("f", "v").distinct().collect()}
    if len({v for _, v in known}) < 2:
        return None
    scored = C.materialize(scores(urls, **sizes), "scores")
    usable = [f for f in range(FOLDS) if len({v for g, v in known if g != f}) == 2]
    at = F.floor((F.least(F.greatest(F.col("held"), F.lit(-_SPAN)), F.lit(_SPAN)) + _SPAN) / (2 * _SPAN) * _BINS)
    of = lambda yes: F.sum(F.when(yes, F.col("w")).otherwise(0))
    hist = scored.where(F.col("v").isNotNull() & F.col("f").isin(usable)).groupBy(F.least(at, F.lit(_BINS - 1)).alias("bin")).agg(of(F.col("v") == "allow").alias("good"), of(F.col("v") != "allow").alias("bad")).toPandas()
    good, bad, cut = np.zeros(_BINS), np.zeros(_BINS), 0.0
    good[hist.bin] += hist.good
    bad[hist.bin] += hist.bad
    if good.sum() and bad.sum():
        # a cut below bin b rejects all bins before it; take the least balanced error, ties nearest to zero
        wrong = np.r_[0, np.cumsum(good)] / good.sum() + 1 - np.r_[0, np.cumsum(bad)] / bad.sum()
        edge = np.arange(_BINS + 1) / _BINS * 2 * _SPAN - _SPAN
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        cut = float(edge[best[np.argmin(np.abs(edge[best]))]])
    return scored.select("u", "w", "llr"), cut


def judge(pages: DataFrame, url: str = "url", rules=RULES, **sizes) -> DataFrame:
    """Pages with ``host, path, rule, llr, verdict``."""
    C.check_columns(pages, url)
    new = ["host", "path", "rule", "llr", "verdict"]
    pages = C.without(pages, new)
    behind, known, weight = C.fresh(pages, "_rest", "_verdict", "_rows")
    host, path, rest = parts(F.col(url))
    ruled = pages.withColumns({"host": host, "path": path, behind: rest})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = ruled.withColumns({"rule": rule, known: verdict})
    found = learn(ruled, behind, known, **sizes)
    if found is None:
        scored = ruled.withColumn("llr", F.lit(0.0))
        cut = 0.0
    else:
        own, cut = found
        scored = C.hot_join(ruled, own.withColumnsRenamed({"u": behind, "w": weight}), behind, weight)
    learned = F.when(F.col("llr") >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("verdict", F.coalesce(known, learned)).select(*pages.columns, *new)
