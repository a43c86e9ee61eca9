"""Modified Kneser-Ney word bigrams over a byte model, spread over the cluster.

Every word of a text, and one mark that closes the text and stands before its
first word, is a token keyed by a 64-bit hash of its language and exact bytes.
Bigrams are interpolated with the byte model ``b`` of their language,

    p(w | v) = max(c(v w) - D(c(v w)), 0) / c(v) + gamma(v) b(w),
    gamma(v) = (D1 N1(v) + D2 N2(v) + D3 N3+(v)) / c(v),

with the discounts of modified Kneser-Ney, estimated from the counts of counts.
A text is scored by the counts that all other texts leave: its own tokens are
taken out of ``c(v w)`` and ``c(v)``; a context that no other text holds backs off
to ``b``.  So the model grows with the corpus and is never gathered or broadcast.

Bigrams are shuffled once, by the hash of their context.  A chunk of texts sends
each partition one *packet*: its bigrams as sorted arrays of hashes (34 bits
context, 24 bits word, besides the partition) in differences, their counts, back-off values and texts, all
in byte planes compressed by Zstandard (about four bytes a token).  A
partition merges its packets to one sorted array, counts, and returns a sum a
text and packet.  Discounts are estimated in each partition, which holds a random
part of all contexts.

A packet holds about chunk tokens * ``PART_TOKENS`` / all tokens of them, and costs
some hundred bytes itself: with more than a terabyte of texts ``PART_TOKENS`` and
``CHUNK`` should be raised with the executors' memory (a partition takes 80 bytes a
token) so that this stays above a hundred.

Contexts of over ``HOT_TOKENS`` tokens are split by the word that follows, in
parts of about ``SPLIT_TOKENS``; their gamma is that of the part, their ``c(v)`` the
whole one.  There are fewer than tokens / ``HOT_TOKENS`` such contexts (16 bytes
for every 12 MB of text), which are broadcast.
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

PART_TOKENS, HOT_TOKENS, SPLIT_TOKENS, CHUNK, CHUNK_ROWS = 3_000_000, 2_000_000, 500_000, 12 << 20, 65_535
_MARK, _LANG = X.U64(0xA24BAED4963EE407), X.U64(0x9FB21C651E98DF25)
#: Bits of the word in a bigram's key, of the part number in a split context, and steps a nat of back-off values and of sums.
_WORD_BITS, _PART_BITS, _STEPS, _SUM_STEPS = 24, 15, 4, 4096
_SPLIT, _WORD = X.U64(1 << 39), X.U64((1 << _WORD_BITS) - 1)


#: Columns of a packet's keys.
KEYS = ("kc", "ks", "kw", "kb", "ki")


def lang_hash(lang: str | None) -> int:
    raw = b"\0" if lang is None else b"\1" + lang.encode("utf-8", "surrogatepass")
    buf = np.frombuffer(raw + b"\0" * 8, np.uint8)
    return int(X.mix(X.hash_spans(buf, np.zeros(1, np.int64), np.array([len(raw)])) ^ _LANG)[0])


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the first place of each, and the place in them of every value, in little memory."""
    order = np.argsort(a, kind="stable").astype(np.int32)
    s = a[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    inverse = np.empty(len(a), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return s[new], order[new], inverse


def tokens(first: np.ndarray, h: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, hash before it, row and place of the word (-1: the mark) of every token; ``model`` is a hash a row."""
    n = len(first) - 1
    size = np.diff(first)
    rows = np.repeat(np.arange(n, dtype=np.int32), size + 1)
    word, place = np.empty(len(rows), X.U64), np.full(len(rows), -1, np.int32)
    at = np.arange(len(h)) + np.repeat(np.arange(n), size)
    place[at] = np.arange(len(h))
    word[at] = X.mix(h ^ model[rows[at]])
    end = first[1:] + np.arange(n)
    word[end] = X.mix(model ^ _MARK)
    before = np.r_[word[:1], word[:-1]]
    before[end - size] = word[end]
    if (size > 0).all():
        return word, before, rows, place
    keep = np.repeat(size > 0, size + 1)
    return word[keep], before[keep], rows[keep], place[keep]


def squeeze(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    raw = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def pack_keys(key: np.ndarray, back: np.ndarray) -> tuple[bytes, ...]:
    """Sorted distinct keys and their words' back-off values, compressed.

    Contexts as differences and numbers of words; the distinct words (frequent ones
    first, so most indices are small) as differences with one value each; and the
    index of each key's word.
    """
    context, word = key >> X.U64(_WORD_BITS), (key & _WORD).astype(np.uint32)
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    kinds, one, inverse, count = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((kinds, -np.frexp(count)[1]))
    place = np.empty(len(kinds), np.uint32)
    place[order] = np.arange(len(kinds))
    step = np.diff(np.r_[np.uint32(0), kinds[order]]) & np.uint32(_WORD)
    return tuple(map(squeeze, (np.diff(np.r_[X.U64(0), context[first]]), np.diff(np.r_[first, len(key)]).astype(np.uint32), step, back[one[order]].astype(np.uint32), place[inverse])))


def unpack_keys(contexts: bytes, sizes: bytes, words: bytes, values: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = unsqueeze(places, np.uint32)
    word = np.cumsum(unsqueeze(words, np.uint32), dtype=X.U64) & _WORD
    return (np.repeat(np.cumsum(unsqueeze(contexts, X.U64)), unsqueeze(sizes, np.uint32)) << X.U64(_WORD_BITS)) | word[at], unsqueeze(values, np.uint32)[at]


def parts_of(b: pa.RecordBatch, lang: int, text: int):
    """(first row, last row, bytes, word starts, word ends, languages, tokens) of each chunk with words."""
    langs = b.column(lang).to_pylist()
    for low, high, off, buf in X.chunks(b.column(text), CHUNK):
        for lo in range(low, high, CHUNK_ROWS):
            hi = min(lo + CHUNK_ROWS, high)
            own, raw = off[lo - low : hi - low + 1], buf
            if hi - lo < high - low:
                raw = np.r_[buf[own[0] : own[-1]], np.zeros(8, np.uint8)]
                own = own - own[0]
            starts, ends, first = X.split(own, raw)
            if len(starts):
                names = {g: lang_hash(g) for g in dict.fromkeys(langs[lo:hi])}
                hashed = np.array([names[g] for g in langs[lo:hi]], X.U64)
                yield lo, hi, raw, starts, ends, langs[lo:hi], tokens(first, X.hash_spans(raw, starts, ends), hashed)


def hot_contexts(docs: DataFrame, least: int = HOT_TOKENS) -> tuple[int, np.ndarray, np.ndarray]:
    """All tokens; the sorted hashes and counts of words with over ``least`` tokens.

    A task leaves out words of fewer than its share of half of ``least``, so every
    such word is seen; those seen are then counted over all texts.
    """
    tasks = max(1, docs.select(docs.columns[2]).rdd.getNumPartitions())
    local = max(1, least // (2 * tasks))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, keys, count = 0, np.zeros(0, X.U64), np.zeros(0, np.int64)
        for b in batches:
            for *_, (w, _, _, _) in parts_of(b, 1, 2):
                total += len(w)
                keys, inverse = np.unique(np.concatenate([keys, w]), return_inverse=True)
                both = np.zeros(len(keys), np.int64)
                np.add.at(both, inverse[: len(count)], count)
                count = both + np.bincount(inverse[len(count) :], minlength=len(keys))
        often = count >= local
        yield pa.record_batch({"w": pa.array(np.r_[np.zeros(1, np.int64), keys[often].view(np.int64)]), "all": pa.array([True] + [False] * int(often.sum())), "n": pa.array(np.r_[np.int64(total), count[often]])})

    found = C.materialize(docs.mapInArrow(survey, "w long, all boolean, n long").groupBy("w", "all").agg(F.sum("n").alias("n")), "survey")
    total = (found.where("all").first() or {"n": 0})["n"]
    # those kept hold least / 2 tokens each: fewer than 2 * total / least
    hot = np.sort(np.array([r["w"] for r in found.where((~F.col("all")) & (F.col("n") * 2 >= least)).select("w").collect()], np.int64).view(X.U64))
    counts = np.zeros(len(hot), np.int64)
    if len(hot):

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(hot), np.int64)
            for b in batches:
                for *_, (w, _, _, _) in parts_of(b, 1, 2):
                    yes, slot = K.Model.lookup(hot, w)
                    n += np.bincount(slot[yes], minlength=len(hot))
            yield pa.record_batch({"i": pa.array(np.arange(len(hot)), pa.int32()), "n": pa.array(n)})

        for r in docs.mapInArrow(exact, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            counts[r["i"]] = r["n"]
    keep = counts > least
    return total, hot[keep], counts[keep]


def keys_of(w: np.ndarray, v: np.ndarray, hot: np.ndarray, counts: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted-array key, partition hash) of each bigram v w."""
    context = v >> X.U64(30)
    route = X.mix(v + _LANG)
    yes, slot = K.Model.lookup(hot, v)
    if yes.any():
        ways = np.minimum(-(-counts[slot[yes]] // split), 1 << _PART_BITS).astype(X.U64)
        part = X.mix(w[yes] + _MARK) % ways
        context = context.copy()
        context[yes] = _SPLIT | (slot[yes].astype(X.U64) << X.U64(_PART_BITS)) | part
        route[yes] = X.mix(route[yes] ^ X.mix(part + X.U64(1)))
    return (context << X.U64(_WORD_BITS)) | (w >> X.U64(64 - _WORD_BITS)), route


def discounts(counts: np.ndarray) -> np.ndarray:
    return K._discounts(counts)


def score_packets(kinds: list[np.ndarray], count: list[np.ndarray], back: list[np.ndarray], rows: list[np.ndarray], hot_counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, summed log-probabilities) of each packet of one partition."""
    table, _, inverse = distinct(np.concatenate(kinds))  # the partition's sorted hash array
    n = np.concatenate(count)
    both = np.bincount(inverse, n, len(table)).astype(np.int64)
    cut = discounts(both)
    context = table >> X.U64(_WORD_BITS)
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    where = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(table)]))
    single = np.add.reduceat(both, first)
    gamma = np.add.reduceat(cut[np.minimum(both, 3)], first) / single
    context = context[first]
    split = (context & _SPLIT) > 0
    single[split] = hot_counts[((context[split] & ~_SPLIT) >> X.U64(_PART_BITS)).astype(np.int64)]
    # tokens, and of each how often its text holds its bigram and its context
    base = np.cumsum([0, *[int(r.max()) + 1 for r in rows]])
    kind = np.repeat(np.arange(len(n), dtype=np.int32), n)
    text = np.concatenate([r.astype(np.int32) + np.int32(b) for r, b in zip(rows, base)])
    new = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (text[1:] != text[:-1])])
    size = np.diff(np.r_[new, len(kind)]).astype(np.int32)
    kind, text = kind[new], text[new]
    del new
    at = inverse[kind]
    same = distinct(where[at].astype(np.int64) * int(base[-1]) + text)[2]
    own = np.bincount(same, size).astype(np.int32)
    byte = np.concatenate(back)
    total, seen = np.zeros(base[-1]), np.zeros(base[-1], bool)
    seen[text] = True
    for lo in range(0, len(text), 1 << 19):
        x = slice(lo, lo + (1 << 19))
        a, c, m = at[x], where[at[x]], size[x]
        left, rest = both[a] - m, single[c] - own[same[x]]
        log_b = -byte[kind[x]].astype(float) / _STEPS
        b = np.exp(log_b)
        p = np.where(rest > 0, np.maximum(left - cut[np.minimum(left, 3)], 0) / np.maximum(rest, 1) + gamma[c] * b, b)
        low = np.flatnonzero(p < 1e-300)  # words of some hundred bytes that only the byte model knows
        p[low] = 1
        logs = np.log(p)
        logs[low] = log_b[low] + np.log(np.where(rest[low] > 0, gamma[c[low]], 1))
        total += np.bincount(text[x], m * logs, base[-1])
    out = []
    for lo, hi in zip(base[:-1], base[1:]):
        d = np.flatnonzero(seen[lo:hi])
        out.append((d, total[lo:hi][d]))
    return out


def scores(docs: DataFrame, models: dict[str | None, K.Model | K.Mapped], part_tokens: int = PART_TOKENS, hot_tokens: int = HOT_TOKENS, split_tokens: int = SPLIT_TOKENS) -> DataFrame:
    """``key, word_log_p``: log-probability of all tokens of each ``key, lang, text`` with words."""
    spark = docs.sparkSession
    total, hot, hot_counts = hot_contexts(docs, hot_tokens)
    n_parts = max(1, -(-total // part_tokens))
    shared = spark.sparkContext.broadcast((models, hot, hot_counts))  # byte models of quality.MAX_GRAMS at most, or names of mapped files

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, hot, hot_counts = shared.value
        for b in batches:
            ids = np.asarray(b.column(0))
            for lo, hi, buf, starts, ends, langs, (w, v, row, place) in parts_of(b, 1, 2):
                kinds, one, word = distinct(w)
                byte = np.zeros(len(kinds))  # the mark closes every text: b = 1
                names = {g: i for i, g in enumerate(dict.fromkeys(langs))}
                number = np.array([names[g] for g in langs])[row[one]]
                for g, i in names.items():
                    own = np.flatnonzero((number == i) & (place[one] >= 0))
                    if len(own):
                        byte[own] = K.word_logs(models.get(g), buf, starts[place[one[own]]], ends[place[one[own]]])
                back = np.round(-byte * _STEPS).astype(np.uint32)
                key, route = keys_of(w, v, hot, hot_counts, split_tokens)
                part = (route % X.U64(n_parts)).astype(np.uint32)
                del starts, ends, w, v, place, route
                # long texts first: most tokens then have small row numbers
                longest = np.argsort(-np.bincount(row, minlength=hi - lo), kind="stable")
                rank = np.empty(hi - lo, np.uint16)
                rank[longest] = np.arange(hi - lo)
                own_ids, row = ids[lo:hi][longest], rank[row]
                order = np.argsort(row, kind="stable").astype(np.int32)
                order = order[np.argsort(key[order], kind="stable")]
                order = order[np.argsort(part[order], kind="stable")]
                part, key, row, word = part[order], key[order], row[order], word[order]
                p, cut = np.unique(part, return_index=True)
                chunk = int(X.mix(X.mix(ids[lo:hi].view(X.U64)).sum(keepdims=True) + np.array([hi - lo], X.U64) * _LANG)[0])
                out = []
                for q, x, y in zip(p, cut, [*cut[1:], len(part)]):
                    k = key[x:y]
                    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                    n = np.diff(np.r_[new, y - x]).astype(np.uint32)
                    out.append((int(q), chunk - 2**63, squeeze(own_ids) if x == 0 else None, *pack_keys(k[new], back[word[x:y][new]]), squeeze(n), squeeze(row[x:y])))
                for x in range(0, len(out), 64):
                    t = list(zip(*out[x : x + 64]))
                    yield pa.record_batch([pa.array(t[0], pa.int32()), pa.array(t[1], pa.int64()), *[pa.array(c, pa.binary()) for c in t[2:]]], names=["p", "c", "ids", *KEYS, "n", "r"])

    def reduce(t: pa.Table) -> pa.Table:
        read = lambda c, kind: [unsqueeze(x, kind) for x in t.column(c).to_pylist()]
        keys, back = zip(*[unpack_keys(*x) for x in zip(*[t.column(c).to_pylist() for c in KEYS])])
        found = score_packets(keys, read("n", np.uint32), back, read("r", np.uint16), shared.value[2])
        return pa.table({"c": t.column("c"), "ids": t.column("ids"), "d": pa.array([squeeze(np.diff(np.r_[0, d]).astype(np.uint16)) for d, _ in found], pa.binary()), "s": pa.array([squeeze(np.round(-s * _SUM_STEPS).astype(np.int64)) for _, s in found], pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        # equal chunks have one number, one list of ids and equal sums
        ids = [unsqueeze(x, np.int64) for x in t.column("ids").to_pylist() if x is not None]
        total, some = np.zeros(len(ids[0])), np.zeros(len(ids[0]), bool)
        for d, s in zip(t.column("d").to_pylist(), t.column("s").to_pylist()):
            at = np.cumsum(unsqueeze(d, np.uint16), dtype=np.int64)
            total[at] -= unsqueeze(s, np.int64) / _SUM_STEPS
            some[at] = True
        return pa.table({"key": pa.array(ids[0][some]), "s": pa.array(total[some] / len(ids))})

    packets = docs.mapInArrow(pack, f"p int, c long, ids binary, {', '.join(f'{k} binary' for k in KEYS)}, n binary, r binary")
    replies = packets.groupBy("p").applyInArrow(reduce, "c long, ids binary, d binary, s binary")
    summed = replies.groupBy("c").applyInArrow(gather, "key long, s double")
    return summed.groupBy("key").agg(F.avg("s").alias("word_log_p"))
