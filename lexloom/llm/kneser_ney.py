"""Modified Kneser-Ney over bytes, stored in sorted key arrays.

Words are read as their bytes, none folded, each word between boundary marks.
An n-gram packs into 9 bits a symbol, so its key is exact (a perfect hash);
contexts and suffixes follow by shifting.  Look-up is a binary search in sorted
arrays.  A model too large to be gathered is computed by Spark (``fit_spread``) and
read by the workers from a memory-mapped file.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import common as C

#: Bytes are symbols as they are; ``EDGE`` stands before and behind each word.
ORDER, BITS, EDGE = 4, 9, 256
#: Words that are scored at a time, to bound memory.
SLICE = 100_000


def word_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int = ORDER, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word index, packed n-gram) for each symbol of each word and its end."""
    size = ends - starts
    lead = order - 1
    full = size + lead + 1
    base = np.cumsum(full) - full
    out = np.full(int(full.sum()), EDGE, np.int64)
    inside = np.arange(int(size.sum())) + np.repeat(base + lead - (np.cumsum(size) - size), size)
    out[inside] = buf[np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)]
    key = np.zeros(len(out), np.int64)
    for k in range(order):
        key[lead:] = (key[lead:] << bits) | out[k : len(out) - lead + k]
    word = np.repeat(np.arange(len(size)), size + 1)
    at = np.arange(len(word)) + lead * (word + 1)
    return word, key[at]


def _discounts(counts: np.ndarray) -> np.ndarray:
    n = [float((counts == k).sum()) for k in (1, 2, 3, 4)]
    if not all(n):
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))]
    return np.array([min(max(x, 0.05), max(k - 0.05, 0.0)) if k else 0.0 for k, x in enumerate(d)])


@dataclass
class Model:
    """Per order k: sorted keys and probabilities; sorted contexts and back-off weights."""

    keys: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    gammas: list[np.ndarray]
    bits: int = BITS

    @staticmethod
    def lookup(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        slot = np.minimum(np.searchsorted(table, asked), len(table) - 1)
        return table[slot] == asked, slot

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of each n-gram's conditional probability."""
        kinds, back = np.unique(grams, return_inverse=True)
        p = np.full(len(kinds), 1.0 / (1 << self.bits))
        for k in range(1, len(self.keys) + 1):
            own = kinds & ((1 << (self.bits * k)) - 1)
            known, slot = self.lookup(self.contexts[k - 1], own >> self.bits)
            if known.any():
                p[known] *= self.gammas[k - 1][slot[known]]
            hit, slot = self.lookup(self.keys[k - 1], own)
            if hit.any():
                p[hit] = self.probs[k - 1][slot[hit]]
        return np.log(p)[back]


def fit(grams: np.ndarray, counts: np.ndarray, order: int = ORDER, bits: int = BITS) -> Model:
    """Model of distinct highest-order n-grams and their counts."""
    by = np.argsort(grams)
    level, count = grams[by], counts[by].astype(np.int64)
    tables: list[tuple[np.ndarray, np.ndarray]] = [(level, count)]
    for k in range(order - 1, 0, -1):
        # continuation counts: in how many different left contexts a suffix stands
        level, count = np.unique(level & ((1 << (bits * k)) - 1), return_counts=True)
        tables.insert(0, (level, count))
    model = Model([], [], [], [], bits)
    for k, (keys, count) in enumerate(tables, 1):
        d = _discounts(count)
        cut = d[np.minimum(count, 3)]
        context, where = np.unique(keys >> bits, return_inverse=True)
        total = np.bincount(where, count, len(context))
        gamma = np.bincount(where, cut, len(context)) / total
        if k == 1:
            lower = np.full(len(keys), 1.0 / (1 << bits))
        else:
            below = keys & ((1 << (bits * (k - 1))) - 1)
            lower = model.probs[k - 2][np.searchsorted(model.keys[k - 2], below)]
        model.keys.append(keys)
        model.probs.append((count - cut) / total[where] + gamma[where] * lower)
        model.contexts.append(context)
        model.gammas.append(gamma)
    return model


@dataclass
class Mapped:
    """One language's part of the files of ``fit_spread``: sorted n-grams and their log-probabilities."""

    file: str
    first: int
    size: int

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of each n-gram's conditional probability; the model holds all of the texts it was counted on."""
        kinds, back = np.unique(grams, return_inverse=True)
        keys, logs = (np.memmap(SparkFiles.get(f"{self.file}.{k}"), kind, "r", 8 * self.first, self.size) for k, kind in (("keys", np.int64), ("logs", np.float64)))
        slot = np.minimum(np.searchsorted(keys, kinds), self.size - 1)
        if (keys[slot] != kinds).any():
            raise ValueError("an n-gram of a text that the model was not counted on")
        return np.asarray(logs[slot])[back]


def _spread_discounts(n: list[Column]) -> list[Column]:
    """``_discounts`` of the columns of counts of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1])
    some = F.least(*n) > 0
    return [F.when(some, F.least(F.greatest(k - (k + 1) * y * n[k] / n[k - 1], F.lit(0.05)), F.lit(k - 0.05))).otherwise(F.lit(x)) for k, x in ((1, 0.5), (2, 0.75), (3, 1.0))]


def fit_spread(grams: DataFrame, order: int = ORDER, bits: int = BITS) -> dict[str | None, Mapped]:
    """``fit`` of ``lang, gram, n`` for every language by Spark, whatever their number.

    No n-gram is left out.  Probabilities go sorted, a block at a time, through the
    driver into two files (16 bytes an n-gram), which Spark hands to every executor;
    workers map them, so neither the driver nor a worker holds the model in memory.
    """
    spark = grams.sparkSession
    mask = lambda k: F.lit((1 << (bits * k)) - 1)
    lang = F.concat(F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce("lang", F.lit(""))).alias("l")
    tables = [grams.select(lang, F.col("gram").alias("g"), "n")]
    for k in range(order - 1, 0, -1):
        tables.insert(0, C.materialize(tables[0].groupBy("l", F.col("g").bitwiseAND(mask(k)).alias("g")).agg(F.count("*").alias("n")), "suffixes"))
    probs = None
    for k, table in enumerate(tables, 1):
        many = [F.sum((F.col("n") == x).cast("double")) for x in (1, 2, 3, 4)]
        cuts = table.groupBy("l").agg(F.count("*").alias("w"), *[c.alias(f"n{i}") for i, c in enumerate(many, 1)])
        cuts = C.materialize(cuts.select("l", "w", *[d.alias(f"d{i}") for i, d in enumerate(_spread_discounts([F.col(f"n{i}") for i in (1, 2, 3, 4)]), 1)]), "discounts")
        whole = Window.partitionBy("l", F.shiftright("g", bits))  # 2^bits rows at most
        total = F.sum("n").over(whole)
        mass = sum(F.col(f"d{i}") * F.sum((F.least("n", F.lit(3)) == i).cast("long")).over(whole) for i in (1, 2, 3))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = C.hot_join(table, cuts, "l", "w").select("l", "g", ((F.col("n") - cut) / total).alias("own"), (mass / total).alias("gamma"))
        if probs is None:
            own = own.withColumn("lower", F.lit(1.0 / (1 << bits)))
        else:
            below = probs.select("l", F.col("g").alias("s"), F.col("p").alias("lower"))
            own = own.withColumn("s", F.col("g").bitwiseAND(mask(k - 1))).join(below, ["l", "s"])
        probs = C.materialize(own.select("l", "g", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p")), "probabilities")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"keys": pa.array([np.asarray(b.column(0)).tobytes()], pa.binary()), "logs": pa.array([np.log(np.asarray(b.column(1))).tobytes()], pa.binary())})

    folder, name = tempfile.mkdtemp(prefix="lexloom-model-"), f"model-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the files while the application runs
    with open(os.path.join(folder, f"{name}.keys"), "wb") as keys, open(os.path.join(folder, f"{name}.logs"), "wb") as logs:
        for r in probs.orderBy("l", "g").select("g", "p").mapInArrow(block, "keys binary, logs binary").toLocalIterator():
            keys.write(r["keys"])
            logs.write(r["logs"])
    for k in ("keys", "logs"):
        spark.sparkContext.addFile(os.path.join(folder, f"{name}.{k}"))
    out, first = {}, 0
    for r in probs.groupBy("l").count().orderBy("l").collect():  # a row a language
        out[None if r["l"] == "0" else r["l"][1:]] = Mapped(name, first, r["count"])
        first += r["count"]
    return out


def word_logs(model: Model | Mapped | None, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-probability of each word, end included; without a model all symbols are alike."""
    if model is None:
        return (ends - starts + 1) * -np.log(float(1 << BITS))
    out = []
    for lo in range(0, len(starts), SLICE):
        word, gram = word_grams(buf, starts[lo : lo + SLICE], ends[lo : lo + SLICE])
        out.append(np.bincount(word, model.log_prob(gram), len(starts[lo : lo + SLICE])))
    return np.concatenate(out) if out else np.zeros(0)
