"""Op 3: base quality rules, then language-specific perplexity bands.

Two modified Kneser-Ney models are counted by Spark over all documents' words, a
language each: n-grams of exact bytes inside words, and word bigrams that back off
to them (``word_model``), which see word order.  ``log_ppl`` is per byte (word ends
included) by the first, ``word_log_ppl`` per word (and end of the text) by the second.
The bands are set per language over all its documents that pass the base rules:
around the median, ``floor + width * spread / sqrt(length)`` to either side, where
the spread of a side is that of the deviations to it, scaled by the root of their
length (short texts vary more, and texts with copies stretch the lower side only).  Above the upper end of either band a document is rejected as too odd,
below the lower end of the bytes' band as too uniform; the words' band has no lower
end, as a text with copies elsewhere is easy to foretell and not bad for it.

The byte model is the lower order and keeps all n-grams.  Up to ``max_grams`` in all
languages together it is gathered and broadcast; a larger one is computed by Spark
and mapped from files (``kneser_ney.fit_spread``), with the same probabilities.  The
word model keeps all bigrams and grows with the corpus.

Cases: null texts are empty; empty and blank texts have no words and fail the
base rules; the null language is a language, and there may be any number of them;
an empty table gives an empty result; texts are never cut; repeated rows count and
are judged alike; ties don't occur (each row is judged by itself).  Further columns
are left out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import common as C
from lexloom.llm import kneser_ney as K
from lexloom.llm import textnp as X
from lexloom.llm import word_model as W

MAX_GRAMS, WIDTH, FLOOR = 2_000_000, 3.5, 0.02
MIN_WORDS, REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[10] = True


def row_key(doc_id: str, lang: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("long"), lang, text).alias("key")


def base_measures(off: np.ndarray, buf: np.ndarray) -> dict[str, np.ndarray]:
    """Base columns of one chunk of texts, and its words."""
    n = len(off) - 1
    starts, ends, first = X.split(off, buf)
    rows = np.repeat(np.arange(n), np.diff(first))
    h = X.hash_spans(buf, starts, ends)
    body = buf[: len(buf) - 8]
    upto = np.r_[0, np.cumsum((body & 0xC0) != 0x80)]
    chars = np.bincount(rows, upto[ends] - upto[starts], n).astype(np.int64)
    sums = np.r_[0, np.cumsum(_SYMBOL[body])]
    symbols = sums[off[1:]] - sums[off[:-1]]
    # lines with a word, equal to an earlier one of their row
    ls, le, lf = X.split(off, buf, _BREAK)
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    lr = np.repeat(np.arange(n), np.diff(lf))[has]
    lh = X.hash_spans(buf, ls[has], le[has])
    key = X.mix(lh ^ X.mix(lr.astype(X.U64)))
    _, kept = np.unique(key, return_index=True)
    dup = np.bincount(lr, minlength=n) - np.bincount(lr[kept], minlength=n)
    # words in 3-word windows that occur twice or more in their row
    at, wr = X.window_starts(first, 3)
    repeat = np.zeros(n, np.int64)
    if len(at):
        key = X.mix(X.ngram_hashes(h, 3)[at] ^ X.mix(wr.astype(X.U64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[count[inverse] > 1]
        mark = np.zeros(len(starts), bool)
        for k in range(3):
            mark[hit + k] = True
        repeat = np.bincount(rows[mark], minlength=n)
    return {"n_words": np.diff(first), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
            "starts": starts, "ends": ends, "rows": rows, "h": h}


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang, gram, n`` over all words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for lo, hi, off, buf in X.chunks(b.column(1), 4 << 20):
                starts, ends, first = X.split(off, buf)
                h = X.hash_spans(buf, starts, ends)
                names = {g: i for i, g in enumerate(dict.fromkeys(langs[lo:hi]))}
                row_lang = np.array([names[g] for g in langs[lo:hi]])
                word_lang = row_lang[np.repeat(np.arange(hi - lo), np.diff(first))]
                for g, i in names.items():
                    own = np.flatnonzero(word_lang == i)
                    if not len(own):
                        continue
                    _, one, often = np.unique(h[own], return_index=True, return_counts=True)
                    word, gram = K.word_grams(buf, starts[own[one]], ends[own[one]])
                    keys, inverse = np.unique(gram, return_inverse=True)
                    n = np.bincount(inverse, often[word], len(keys)).astype(np.int64)
                    if g in held:
                        keys, inverse = np.unique(np.concatenate([held[g][0], keys]), return_inverse=True)
                        n = np.bincount(inverse, np.concatenate([held[g][1], n]), len(keys)).astype(np.int64)
                    held[g] = keys, n
        for g, (keys, n) in held.items():
            yield pa.record_batch({"lang": pa.array([g] * len(keys), pa.string()), "gram": pa.array(keys), "n": pa.array(n)})

    return docs.select(lang, text).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", max_grams: int = MAX_GRAMS) -> dict[str | None, K.Model | K.Mapped]:
    """A byte model of all n-grams for each language; more than ``max_grams`` in all are not gathered."""
    grams = C.materialize(count_grams(docs, lang, text), "grams")
    if grams.count() > max_grams:
        return K.fit_spread(grams)
    table = grams.toPandas()
    return {None if isinstance(g, float) or g is None else g: K.fit(t.gram.to_numpy(), t.n.to_numpy()) for g, t in table.groupby("lang", dropna=False)}


def measure(docs: DataFrame, models: dict[str | None, K.Model | K.Mapped], doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Base columns, ``base_failed`` and ``log_ppl`` per document."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            langs = b.column(1).to_pylist()
            for lo, hi, off, buf in X.chunks(b.column(2), 4 << 20):
                m = base_measures(off, buf)
                names = {g: i for i, g in enumerate(dict.fromkeys(langs[lo:hi]))}
                word_lang = np.array([names[g] for g in langs[lo:hi]])[m["rows"]]
                total = np.zeros(hi - lo)
                for g, i in names.items():
                    at = np.flatnonzero(word_lang == i)
                    if len(at):
                        _, one, inverse = np.unique(m["h"][at], return_index=True, return_inverse=True)
                        logs = K.word_logs(own.get(g), buf, m["starts"][at[one]], m["ends"][at[one]])
                        total += np.bincount(m["rows"][at], logs[inverse], hi - lo)
                length = np.bincount(m["rows"], m["ends"] - m["starts"] + 1, hi - lo)
                ppl = np.where(length > 0, -total / np.maximum(length, 1), 0.0)
                words = m["n_words"]
                failed = (words < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * words)
                yield pa.record_batch({
                    "key": b.column(3).slice(lo, hi - lo), "doc_id": b.column(0).slice(lo, hi - lo), "lang": b.column(1).slice(lo, hi - lo),
                    **{c: pa.array(m[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
                    "base_failed": pa.array(failed), "log_ppl": pa.array(ppl), "symbols": pa.array(length.astype(np.int64))})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), text, row_key(doc_id, lang, text)).mapInArrow(
        run, "key long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ppl double, symbols long")


def with_bands(measured: DataFrame, width: float, floor: float) -> DataFrame:
    """Add ``low, high, word_high`` of the language, over its documents that pass the base rules.

    The medians and spreads are aggregates with a row a language, joined back.
    """
    measured = measured.withColumn("k", F.concat(F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce("lang", F.lit(""))))
    sizes = {"log_ppl": F.col("symbols"), "word_log_ppl": F.col("n_words") + 1}
    root = {v: F.sqrt(F.greatest(n, F.lit(1)).cast("double")) for v, n in sizes.items()}
    spot = lambda c, x: F.percentile_approx(c, F.lit(x), F.lit(10_000))
    rows = F.count("*").alias("w")
    centers = C.materialize(measured.groupBy("k").agg(rows, *[spot(F.when(~F.col("base_failed"), F.col(v)), 0.5).alias(f"{v}_mid") for v in sizes]), "centers")
    measured = C.hot_join(measured, centers, "k", "w")
    off = {v: F.when(~F.col("base_failed"), (F.col(v) - F.col(f"{v}_mid")) * root[v]) for v in sizes}
    spreads = C.materialize(measured.groupBy("k").agg(rows, *[spot(off[v], x).alias(f"{v}_{x}") for v in sizes for x in (0.25, 0.5, 0.75)]), "spreads")
    measured = C.hot_join(measured, spreads, "k", "w")

    def end(v: str, x: float):
        """The end of a band on the side of quantile x (0.6745 is a normal quartile)."""
        return F.col(f"{v}_mid") + F.lit(2 * x - 1) / F.lit(abs(2 * x - 1)) * (F.lit(floor) + F.lit(width) * F.abs(F.col(f"`{v}_{x}`") - F.col(f"`{v}_0.5`")) / F.lit(0.6745) / root[v])

    return measured.withColumns({"low": end("log_ppl", 0.25), "high": end("log_ppl", 0.75), "word_high": end("word_log_ppl", 0.75)})


def judge(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", width: float = WIDTH, floor: float = FLOOR, max_grams: int = MAX_GRAMS, **word_model) -> DataFrame:
    """``measure`` with ``word_log_ppl``, the bands ``low, high, word_high`` and ``kept`` of each document."""
    C.check_columns(docs, doc_id, lang, text)
    models = fit(docs, lang, text, max_grams)
    first = measure(docs, models, doc_id, lang, text)
    words = W.scores(docs.select(row_key(doc_id, lang, text), F.col(lang).alias("lang"), F.col(text).alias("text")), models, **word_model)
    # equal rows have one key and one score
    scored = first.join(words, "key", "left").withColumn("word_log_ppl", -F.col("word_log_p") / (F.col("n_words") + 1))
    measured = C.materialize(scored.drop("key", "word_log_p"), "measured")
    banded = with_bands(measured, width, floor)
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")) & (F.col("word_log_ppl") <= F.col("word_high")), F.lit(False))
    return banded.withColumn("kept", ~F.col("base_failed") & inside).select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "low", "high", "word_log_ppl", "word_high", "kept")
