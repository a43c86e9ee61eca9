"""Op 5: SentencePiece encoding and decoding over a relational lattice.

Texts fall apart in *units* (a run of spaces with the word behind it) that no
piece can cross.  The ``table_rows`` most frequent units over all texts go
through a relational lattice: every substring of bounded length is exploded,
equi-joined to the piece table, and the surviving edges of a word are grouped
and folded by a Spark higher-order ``aggregate``.

The fold depends on the kind of model.  A unigram model is folded by Viterbi
(``viterbi``).  The bundled model is a BPE model, for which a best-score path is
not what the library gives; its edges are folded in order of merge rank instead:
the state is a bit mask of the cuts left in the word, and an edge that spans
exactly one cut removes it.  One pass in that order equals the library wherever
each piece is built by merges of rising rank; pieces for which that isn't so are
found once per model (``risky``); a model that has some is refused.

The encoding pass is one map: units are looked up in the broadcast table, whose
size is bounded; units not in it, words of over ``MAX_CHARS`` characters (a bit
mask has 64) and words behind several spaces (pieces of spaces tie) go through the same lattice inside the worker (``lattice``: the three
steps in numpy, many words at a time) once, and are cached.  No unit is dropped, none
is encoded by the library, and ids never depend on what the table holds.  Joining
all units back to their documents instead would shuffle more than the texts.
Decoding gathers the pieces' bytes.

Cases: null and empty texts have no ids and decode to the empty text; texts are
never cut; characters without a piece become byte pieces; a literal U+2581 is a
space to the model and decodes to one; repeated rows encode alike; an empty
table gives an empty result; columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import common as C
from lexloom.llm import pieces as P
from lexloom.llm import textnp as X
from lexloom.llm import token_counts
from lexloom.llm.lattice import Lattice

TABLE_ROWS, PER_PARTITION, CACHE_ROWS, MAX_CHARS, UNITS = 131_072, 32_768, 400_000, 60, 20_000
#: Places of the fields of a packed edge: rank from bit 32, id below bit 20.
_START, _LENGTH, _ID = 26, 20, (1 << 20) - 1


def piece_rows(path: str) -> list[tuple[str, int, float]]:
    """(piece, id, score) of all ordinary pieces."""
    sp = P.processor(path)
    return [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def ranks(path: str) -> dict[str, int]:
    """Merge rank of each piece: 0 for the best score, equal for equal scores."""
    rows = piece_rows(path)
    place = {x: i for i, x in enumerate(sorted({x for _, _, x in rows}, reverse=True))}
    return {p: place[x] for p, _, x in rows}


def merge_order(word: str, rank: dict[str, int]) -> tuple[list[str], list[int]]:
    """Reference BPE: the best-ranked neighbouring pair first, leftmost of equals."""
    parts, ranks = list(word), []
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return parts, ranks
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        ranks.append(best[0])


@lru_cache(maxsize=4)
def risky(path: str) -> frozenset[str]:
    """Pieces that merges of falling rank build: one ordered pass may miss them."""
    rank = ranks(path)
    return frozenset(p for p in rank if len(p) > 1 and (r := merge_order(p, rank)[1]) != sorted(r))


def edges(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """``word, n, edges``: the lattice of each distinct ``word`` (no further columns).

    Edges are packed longs of rank, start, length and id (from the high bits down),
    so sorting them sorts by merge rank and then from left to right.  Words come hash partitioned,
    which exploding and a broadcast join keep: grouping adds no shuffle.
    """
    n = F.char_length("word")
    sub = (
        words.withColumn("n", n.cast("int"))
        .withColumn("i", F.explode_outer(F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1))))
        .withColumn("len", F.explode_outer(F.when(F.col("n") > 1, F.sequence(F.lit(2), F.least(F.lit(longest), F.col("n") - F.col("i") + 1)))))
        .withColumn("piece", F.substring("word", F.col("i"), F.col("len")))
    )
    parts = [(F.col("rank"), 32), (F.col("i") - 1, _START), (F.col("len"), _LENGTH), (F.col("id"), 0)]
    packed = F.when(F.col("id").isNotNull(), reduce(Column.bitwiseOR, [F.shiftleft(c.cast("long"), k) for c, k in parts]))
    # the piece table has as many rows as the model: bounded
    return sub.join(F.broadcast(table), "piece", "left").groupBy("word", "n").agg(F.sort_array(F.collect_list(packed)).alias("edges"))


def _field(edge: Column, shift: int) -> Column:
    return F.shiftright(edge, shift).bitwiseAND(F.lit(63).cast("long")).cast("int")


def _one(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def merge_fold(edge_list: Column, n: Column) -> tuple[Column, Column]:
    """The fold's last state (to be named ``cuts``), and the packed multi-character
    pieces that it leaves when edges merge by rank.

    Bit k of the state says that a cut stands before character k.
    """
    ends = lambda e: _one(_field(e, _START)).bitwiseOR(_one(_field(e, _START) + _field(e, _LENGTH)))
    inner = lambda e: _one(_field(e, _START) + _field(e, _LENGTH)) - F.call_function("shiftleft", F.lit(2).cast("long"), _field(e, _START))

    def step(cuts: Column, e: Column) -> Column:
        merges = (cuts.bitwiseAND(ends(e)) == ends(e)) & (F.bit_count(cuts.bitwiseAND(inner(e))) == 1)
        return F.when(merges, cuts.bitwiseAND(F.bitwise_not(inner(e)))).otherwise(cuts)

    cuts = F.aggregate(edge_list, F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1, step)
    left = lambda e: (F.col("cuts").bitwiseAND(ends(e)) == ends(e)) & (F.col("cuts").bitwiseAND(inner(e)) == 0)
    return cuts, F.filter(edge_list, left)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``word, chosen``: packed multi-character pieces of each distinct word."""
    spark = words.sparkSession
    rows = piece_rows(path)
    rank = ranks(path)
    table = spark.createDataFrame([(p, i, rank[p]) for p, i, _ in rows if len(p) > 1], "piece string, id int, rank int")
    lattice = edges(words.where(F.char_length("word") <= MAX_CHARS), table, max(len(p) for p, _, _ in rows))
    if risky(path):
        raise ValueError(f"pieces built by merges of falling rank: {sorted(risky(path))[:5]}")
    cuts, chosen = merge_fold(F.col("edges"), F.col("n"))
    return lattice.withColumn("cuts", cuts).select("word", chosen.alias("chosen"))


def viterbi(words: DataFrame, table: DataFrame, unknown: float = -1e3) -> DataFrame:
    """Best-score segmentation of each distinct word for a unigram model.

    ``table`` has ``piece, score``; a character without a piece costs ``unknown``.
    Edges are grouped by end and folded by ``aggregate``, which keeps the best
    score and the best last start at every position; ties prefer the longer piece.
    Returns ``word, pieces array<string>, score``.
    """
    longest = table.agg(F.max(F.char_length("piece"))).first()[0] or 1
    sub = (
        words.withColumn("n", F.char_length("word").cast("int")).where("n > 0")
        .withColumn("e", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("s", F.explode(F.sequence(F.greatest(F.lit(1), F.col("e") - longest + 1), F.col("e"))))
        .withColumn("piece", F.substring("word", F.col("s"), F.col("e") - F.col("s") + 1))
    )
    scored = sub.join(F.broadcast(table.select("piece", "score")), "piece", "left").withColumn("score", F.when(F.col("score").isNull() & (F.col("s") == F.col("e")), F.lit(unknown)).otherwise(F.col("score").cast("double")))
    lattice = scored.groupBy("word", "n").agg(F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("e", "s", "score")))).alias("edges"))
    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("starts")))

    def step(best: Column, e: Column) -> Column:
        before = F.element_at(best, e["s"])
        path = F.struct((before["score"] + e["score"]).alias("score"), F.concat(before["starts"], F.array(e["s"])).alias("starts"))
        old = F.element_at(best, -1)
        better = F.when(old["score"] >= path["score"], old).otherwise(path)
        return F.when(F.size(best) <= e["e"], F.concat(best, F.array(path))).otherwise(F.concat(F.slice(best, 1, F.size(best) - 1), F.array(better)))

    best = F.element_at(F.aggregate("edges", zero, step), -1)
    ends = lambda s, k: F.coalesce(F.get(F.col("best.starts"), k + 1), F.col("n") + 1)
    cut = F.transform("best.starts", lambda s, k: F.substring(F.col("word"), s, ends(s, k) - s))
    return lattice.withColumn("best", best).select("word", cut.alias("pieces"), F.col("best.score").alias("score"))


@lru_cache(maxsize=4)
def lattice(path: str) -> Lattice:
    """The worker's lattice."""
    if risky(path):
        raise ValueError(f"pieces built by merges of falling rank: {sorted(risky(path))[:5]}")
    return Lattice(path, piece_rows(path))


class Ids:
    """Ids of units: a sorted table of unit hashes over flat ids, plus a cache."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, flat: np.ndarray):
        order = np.argsort(keys)
        size = np.diff(first)[order]
        at = np.repeat(first[:-1][order] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
        self.keys, self.first, self.flat = keys[order], np.r_[0, np.cumsum(size)], flat[at]

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Place of each hash; -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(asked), -1)
        slot = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[slot] == asked, slot, -1)


def unit_table(spark: SparkSession, path: str, units: list[tuple[int, str]]) -> Ids:
    """Encode frequent units through the lattice."""
    sp = P.processor(path)
    chars = {p: i for p, i, _ in piece_rows(path) if len(p) == 1}

    def single(c: str) -> list[int]:
        return [chars[c]] if c in chars else [sp.piece_to_id(f"<0x{x:02X}>") for x in c.encode("utf-8")]

    word = {P.MARK * k + w: (k, w) for k, w in units if k < 2}  # runs of marks tie, see ``lattice``
    frame = spark.createDataFrame([(w,) for w in word], "word string")
    frame = frame.repartition("word")
    ids: list[list[int]] = []
    names: list[tuple[int, str]] = []
    for r in encode_words(frame, path).toLocalIterator():
        w, chosen = r["word"], r["chosen"]
        spans = {(e >> _START) & 63: (e & _ID, (e >> _LENGTH) & 63) for e in chosen}
        out, k = [], 0
        while k < len(w):
            if k in spans:
                out.append(spans[k][0])
                k += spans[k][1]
            else:
                out.extend(single(w[k]))
                k += 1
        names.append(word[w])
        ids.append(out)
    if not names:
        return Ids(np.zeros(0, X.U64), np.zeros(1, np.int64), np.zeros(0, np.int32))
    data = [w.encode() for _, w in names]
    size = np.array([len(d) for d in data])
    ends = np.cumsum(size)
    buf = np.frombuffer(b"".join(data) + b"\0" * 8, np.uint8)
    h = X.hash_spans(buf, ends - size, ends)
    h = X.mix(h ^ (np.array([k for k, _ in names]).astype(X.U64) * X.U64(0xA24BAED4963EE407)))
    return Ids(h, np.r_[0, np.cumsum([len(x) for x in ids])], np.array([x for y in ids for x in y], np.int32))


def gather(first: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated lists ``at`` of a ragged array, and their sizes."""
    size = (first[1:] - first[:-1])[at]
    where = np.repeat(first[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum())) if len(at) else np.zeros(0, np.int64)
    return flat[where], size


class Encoder:
    """Encodes chunks of texts; units outside the table go through the worker's lattice and are cached.

    The cache is a table of arrays like the broadcast one: a unit takes some 30 bytes.
    """

    def __init__(self, path: str, table: Ids, cache_rows: int = CACHE_ROWS):
        self.table, self.cache_rows = table, cache_rows
        self.cache = Ids(np.zeros(0, X.U64), np.zeros(1, np.int64), np.zeros(0, np.int32))
        self.lattice = lattice(path)
        buf = np.frombuffer(b"\n" + b"\0" * 8, np.uint8)
        self.line = self.lattice.encode(buf, np.array([0]), np.array([1]), np.array([0]))[0]
        self.runs: dict[int, np.ndarray] = {}

    def run(self, spaces: int) -> np.ndarray:
        """Ids of a run of spaces without a word."""
        if spaces not in self.runs:
            if len(self.runs) > 4096:
                self.runs.clear()
            self.runs[spaces] = self.lattice.encode(np.zeros(8, np.uint8), np.array([0]), np.array([0]), np.array([spaces]))[0]
        return self.runs[spaces]

    def __call__(self, off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and the number of ids of each row."""
        u = P.Units(off, buf)
        h = u.hashes()
        # places in the table, behind it in the cache, and behind that among the new units
        slot = self.table.find(h)
        miss = np.flatnonzero(slot < 0)
        old = self.cache.find(h[miss])
        slot[miss[old >= 0]] = len(self.table.keys) + old[old >= 0]
        miss = miss[old < 0]
        distinct, one, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
        new = [self.lattice.encode(buf, u.starts[x], u.ends[x], u.spaces[x]) for x in (miss[one[lo : lo + UNITS]] for lo in range(0, len(one), UNITS))]
        ids, count = (np.concatenate([n[k] for n in new]) if new else np.zeros(0, np.int64) for k in (0, 1))
        slot[miss] = len(self.table.keys) + len(self.cache.keys) + inverse
        runs, run_of = np.unique(u.lone_spaces, return_inverse=True)
        extra = [*(self.run(int(k)) for k in runs), self.line]
        known = [self.table, self.cache]
        flat = np.concatenate([*(t.flat for t in known), ids.astype(np.int32), *extra])
        first = np.r_[0, np.cumsum(np.concatenate([*(np.diff(t.first) for t in known), count, [len(x) for x in extra]]).astype(np.int64))]
        # words, lone runs before newlines, and newlines, in text order
        at = np.concatenate([u.starts * 2 + 1, u.lone_at * 2, u.lines * 2 + 1])
        row = np.concatenate([u.rows, u.lone_rows, u.line_rows])
        last = len(first) - 2
        item = np.concatenate([slot, last - len(runs) + run_of, np.full(len(u.lines), last)]).astype(np.int64)
        order = np.lexsort((at, row))
        out, size = gather(first, flat, item[order])
        if len(distinct) <= self.cache_rows:
            if len(self.cache.keys) + len(distinct) > self.cache_rows:
                self.cache = Ids(distinct, np.r_[0, np.cumsum(count)], ids.astype(np.int32))
            else:
                self.cache = Ids(np.concatenate([self.cache.keys, distinct]), np.r_[self.cache.first, self.cache.first[-1] + np.cumsum(count)], np.concatenate([self.cache.flat, ids.astype(np.int32)]))
        return out, np.bincount(row[order], size, len(off) - 1).astype(np.int64)


@lru_cache(maxsize=4)
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    sp = P.processor(path)
    out = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(P.MARK, " ").encode("utf-8"))
    return np.r_[0, np.cumsum([len(x) for x in out])], np.frombuffer(b"".join(out), np.uint8)


def decode_ids(path: str, ids: np.ndarray, count: np.ndarray) -> pa.Array:
    """Texts of rows of ids (``count`` each); the leading dummy space goes."""
    first, flat = _piece_bytes(path)
    data, size = gather(first, flat, ids)
    rows = np.repeat(np.arange(len(count)), count)
    off = np.r_[0, np.cumsum(np.bincount(rows, size, len(count)).astype(np.int64))]
    drop = off[:-1][(np.diff(off) > 0)]
    drop = drop[data[drop] == 32]
    keep = np.ones(len(data), bool)
    keep[drop] = False
    lost = np.r_[0, np.cumsum(~keep)]
    off = off - lost[off]
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[keep].tobytes())])
    try:
        return text.cast(pa.large_string())
    except pa.ArrowInvalid:  # ids that don't come from an encoder may split characters
        return pa.array([x.decode("utf-8", "replace") for x in text.to_pylist()], pa.large_string())


def encode(docs: DataFrame, path: str | None = None, text: str = "text", table_rows: int = TABLE_ROWS, cache_rows: int = CACHE_ROWS) -> DataFrame:
    """Documents with ``ids array<int>``, ``n_pieces`` and ``round_trip``.

    ``round_trip`` says that the decoded ids equal the text (with U+2581 as space).
    """
    C.check_columns(docs, text)
    path = path or P.model_path()
    new = ["ids", "n_pieces", "round_trip"]
    docs = C.without(docs, new)
    at = docs.columns.index(text)
    units = token_counts.frequent(docs, text, PER_PARTITION, table_rows, lean=True) if table_rows else []
    shared = docs.sparkSession.sparkContext.broadcast(unit_table(docs.sparkSession, path, units))  # bounded by table_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.lean()
        encoder = Encoder(path, shared.value, cache_rows)
        for b in batches:
            for lo, hi, off, buf in X.chunks(P.escape(b.column(at))):
                ids, count = encoder(off, buf)
                decoded = decode_ids(path, ids, count)
                want = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(buf.tobytes()))
                same = pa.compute.equal(decoded, want)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, lists, pa.array(count), same], names=[*b.schema.names, *new])

    full = T.StructType([*docs.schema.fields, *C.schema("ids array<int>, n_pieces long, round_trip boolean").fields])
    return docs.mapInArrow(run, full)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Rows with ``decoded``; null ids decode to null, null elements are skipped."""
    C.check_columns(encoded, ids)
    path = path or P.model_path()
    encoded = C.without(encoded, ["decoded"])
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at)
            rows = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            flat = lists.flatten()
            good = np.asarray(flat.is_valid())
            count = np.bincount(rows[good], minlength=b.num_rows)
            out = decode_ids(path, np.asarray(flat.drop_null()).astype(np.int64), count).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.compute.if_else(lists.is_valid(), out, pa.scalar(None, pa.string()))], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
