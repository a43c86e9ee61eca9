"""Op 1: toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first (case, homoglyphs, digit and symbol substitutions,
zero-width characters), so ``1dіot`` meets ``idiot``.  Lexicon entries are whole
words or word prefixes, each with a log-odds weight; *exception phrases* (a word,
or a word and the next one) that start at the same place cancel a match.  A document's score is a logistic
function of its matched weight, normalised by its length.

Lexicon, exceptions and the logistic curve are learnt from labelled rows; the
classifier's sample is bounded by ``max_rows`` (documented parameter), and so is the
lexicon by ``max_lexicon``.  A pattern must stand in ``MIN_SHARE`` of the toxic rows
and in ``MIN_ROWS`` of them (in half of them, if there are fewer than twice as
many): what stands in less can't be told from chance.  Exceptions are looked for in
all rows under each entry of the lexicon: words, and words with the next one, that
stand in clean rows at least as often.  Scoring reads every whole text once,
map-side, without any shuffle.

Cases: null and empty texts score the curve's value at zero matches; label rows
that are null or without a document are ignored; with no labels of either kind the
built-in ``SEED_LEXICON`` and a fixed curve serve (few labels give a small lexicon,
or none, and a curve fitted on them); of patterns that tie for the last place of a
full lexicon the first by code point stays.  A document labelled twice
with different labels counts for both; repeated rows count as they stand.
Further columns pass through, except those named like an output column, which
are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import common as C

SEED_LEXICON = {" idiot ": 4.0, " moron ": 4.0, " scum ": 4.0, " stupid ": 3.0, " pathetic ": 3.0, " worthless ": 3.0}
#: Bound of the rows that the classifier is fitted on, and of its lexicon.
MAX_ROWS, MAX_LEXICON = 20_000, 4096
#: Support and log-odds of an entry, and log-odds of exceptions (words; words with the next one).
MIN_ROWS, MIN_SHARE, MIN_ODDS, MAX_WORD_ODDS, MAX_PHRASE_ODDS = 4, 0.004, 2.5, 0.5, -1.0
NEW = ["tox_weight", "n_hits", "score", "predicted"]
PREFIXES = range(4, 11)


def _fold_table() -> dict[int, int | None]:
    table: dict[int, int | None] = {}
    for c in range(128):
        if not chr(c).isalnum():
            table[c] = 32
    for c in range(65, 91):
        table[c] = c + 32
    for pair in ("0o", "1i", "3e", "4a", "5s", "7t", "@a", "$s"):
        table[ord(pair[0])] = ord(pair[1])
    look = {
        "a": "аАαΑ", "b": "ВΒ", "c": "сСϲ", "e": "еЕΕε", "h": "НһΗ", "i": "іІιΙı",
        "j": "јЈ", "k": "кКκΚ", "m": "мМΜ", "n": "Ν", "o": "оОοΟ", "p": "рРρΡ", "s": "ѕЅ",
        "t": "тТτΤ", "u": "υ", "v": "νѵ", "x": "хХχΧ", "y": "уУΥ", "z": "Ζ",
    }
    for latin, others in look.items():
        for o in others:
            table[ord(o)] = ord(latin)
    for k in range(26):  # full-width forms
        table[0xFF21 + k] = table[0xFF41 + k] = 97 + k
    for c in (0xA0, 0x2028, 0x2029, 0x3000, *range(0x2000, 0x200B), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0xAB, 0xBB, 0xBF, 0xA1):
        table[c] = 32
    for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):
        table[c] = None
    for c in range(0xC0, 0xDF):
        if c != 0xD7:
            table[c] = c + 32
    return table


FOLD = _fold_table()


def fold(text: str | None) -> str:
    """Folded text between single outer spaces; punctuation becomes spaces."""
    return " " + (text or "").translate(FOLD) + " "


@dataclass
class Model:
    """Patterns (leading space; trailing space for whole words) and the curve."""

    lexicon: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 2.2, 0.4)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.lexicon:
            return None
        auto = ahocorasick.Automaton()
        for p, w in self.lexicon.items():
            auto.add_word(p, (len(p), float(w), False))
        for p in self.exceptions:
            auto.add_word(p, (len(p), 0.0, True))
        auto.make_automaton()
        return auto


def match(auto: ahocorasick.Automaton | None, folded: str) -> tuple[float, int]:
    """Summed weight and number of matched places (the heaviest entry a place)."""
    if auto is None:
        return 0.0, 0
    best: dict[int, float] = {}
    spared: set[int] = set()
    for end, (n, w, spare) in auto.iter(folded):
        at = end - n + 1
        if spare:
            spared.add(at)
        elif w > best.get(at, 0.0):
            best[at] = w
    if spared:
        best = {k: v for k, v in best.items() if k not in spared}
    return sum(best.values()), len(best)


def features(weight: float, words: int) -> tuple[float, float, float]:
    """Length-normalised evidence: a saturating sum and a density."""
    return 1.0, math.log1p(weight / math.sqrt(1.0 + words / 400.0)), math.log1p(50.0 * weight / (words + 50.0))


def curve_score(curve: tuple[float, float, float], weight: float, words: int) -> float:
    z = sum(a * b for a, b in zip(curve, features(weight, words)))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _logit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _patterns(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k < len(w))
    return out


def _exceptions(rows: DataFrame, lexicon: dict[str, float], log_odds) -> list[str]:
    """Words under the lexicon's entries, and words with the next one, that clean rows hold."""
    if not lexicon:
        return []

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Model(lexicon).automaton()
        count: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded = " ".join(["", *fold(t).split(), ""])
                found = set()
                for end, (n, _, _) in auto.iter(folded):
                    at = end - n + 1
                    stop = folded.index(" ", at + 1)
                    found.add(folded[at : stop + 1])
                    if stop + 1 < len(folded):
                        found.add(folded[at : folded.index(" ", stop + 1) + 1])
                count.update((p, y) for p in found)
        at = list(count)
        yield pa.record_batch({"p": pa.array([p for p, _ in at], pa.string()), "bad": pa.array([count[k] * (k[1] == 1) for k in at], pa.int64()), "good": pa.array([count[k] * (k[1] == 0) for k in at], pa.int64())})

    found = rows.select("_t", "_y").mapInArrow(look, "p string, bad long, good long").groupBy("p").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("good > 0").collect()  # words of max_rows texts
    words = {r["p"] for r in found if r["p"].count(" ") == 2 and log_odds(r["bad"], r["good"]) < MAX_WORD_ODDS}
    # a phrase says more than its word only if it is clearly clean
    phrases = {r["p"] for r in found if r["p"].count(" ") == 3 and r["good"] >= 3 and log_odds(r["bad"], r["good"]) < MAX_PHRASE_ODDS}
    return sorted(words - set(lexicon)) + sorted(p for p in phrases if p[: p.index(" ", 1) + 1] not in words)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_rows: int = MAX_ROWS, max_lexicon: int = MAX_LEXICON) -> Model:
    """Fit lexicon, exceptions and curve on at most ``max_rows`` labelled rows.

    The rows are those of the smallest id hash, so the draw repeats.  Toxic rows
    propose patterns; all rows weigh them by log-odds of document frequency.
    """
    C.check_columns(docs, doc_id, text)
    C.check_columns(labels, doc_id, label)
    drawn = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
        .where("_id is not null and _y in (0, 1)")
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(max_rows)
    )
    # bounded by max_rows; exact copies say nothing new, so each text counts once a label
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
        .join(F.broadcast(drawn), "_id")
        .withColumn("_h", F.xxhash64("_t"))
        .dropDuplicates(["_h", "_y"])
        .select("_id", "_t", "_y")
    )
    rows = C.materialize(rows, "toxic-train")
    n = dict(rows.groupBy("_y").count().collect())
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model(dict(SEED_LEXICON))
    least = max(min(MIN_ROWS, math.ceil(toxic / 2)), math.ceil(MIN_SHARE * toxic))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                count.update(_patterns(fold(t)))
        yield pa.record_batch({"p": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})

    proposed = rows.where("_y = 1").select("_t").mapInArrow(propose, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()  # patterns of max_rows texts
    hits = {r["p"]: r["n"] for r in proposed}
    names = list(hits)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = ahocorasick.Automaton()
        for k, p in enumerate(names):
            auto.add_word(p, k)
        if not names:
            return
        auto.make_automaton()
        count = np.zeros(len(names), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                found = {k for _, k in auto.iter(fold(t))}
                count[list(found)] += 1
        at = np.flatnonzero(count)
        yield pa.record_batch({"k": pa.array(at, pa.int64()), "n": pa.array(count[at], pa.int64())})

    seen = {r["k"]: r["n"] for r in rows.where("_y = 0").select("_t").mapInArrow(weigh, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    def log_odds(bad: int, good: int) -> float:
        return math.log((bad + 0.5) / (toxic + 1)) - math.log((good + 0.5) / (clean + 1))

    odds = {p: log_odds(hits[p], seen.get(k, 0)) for k, p in enumerate(names)}
    lexicon: dict[str, float] = {}
    for p in sorted(names, key=lambda p: (len(p.rstrip()), p)):
        shorter = any(p[:k] in lexicon for k in range(5, len(p.rstrip()) + 1) if p[:k] != p)
        if not shorter and odds[p] >= MIN_ODDS:
            lexicon[p] = odds[p]
    lexicon = dict(sorted(lexicon.items(), key=lambda kv: (-kv[1] * math.log1p(hits[kv[0]]), kv[0]))[:max_lexicon])
    model = Model(lexicon, _exceptions(rows, lexicon, log_odds))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = model.automaton()
        for b in batches:
            got = [(*match(auto, f := fold(t)), len(f.split())) for t in b.column(0).to_pylist()]
            yield pa.record_batch({"w": pa.array([g[0] for g in got], pa.float64()), "n": pa.array([g[2] for g in got], pa.int64()), "y": b.column(1)})

    measured = rows.select("_t", "_y").mapInArrow(measure, "w double, n long, y int").toPandas()  # at most max_rows numbers
    x = np.array([features(w, n) for w, n in zip(measured.w, measured.n)])
    model.curve = _logit(x, measured.y.to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents with ``tox_weight, n_hits, score, predicted``; one map over the texts."""
    C.check_columns(docs, text)
    new = NEW
    kept = C.without(docs, new)
    at = kept.columns.index(text)
    out = C.schema(", ".join(["tox_weight double", "n_hits long", "score double", "predicted int"]))
    full = T.StructType([*kept.schema.fields, *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = model.automaton()
        for b in batches:
            weight, hits, value = [], [], []
            for t in b.column(at).to_pylist():
                folded = fold(t)
                w, k = match(auto, folded) if len(folded) > 2 else (0.0, 0)
                weight.append(w)
                hits.append(k)
                value.append(curve_score(model.curve, w, len(folded.split())))
            s = np.array(value, float)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(weight, pa.float64()), pa.array(hits, pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, *new])

    return kept.mapInArrow(run, full)
