"""Units of a SentencePiece model: the word-sized blocks no piece can cross.

Spaces become U+2581 and one is put before the text, as the library does with
an identity normaliser.  No piece holds U+2581 after another character, and
none holds a newline, so a text falls apart in *units*: a run of k spaces with
the word behind it.  Merges never cross units, hence encoding units one by one
is exact, and equal units share one encoding.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexloom.llm import textnp as X

MARK = "▁"
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 10]] = True


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if "\n" in p or MARK in p.lstrip(MARK):
            raise ValueError(f"piece {p!r} crosses units; this model can't be split at spaces")
    if [sp.id_to_piece(i) for i in sp.encode("Ａ  x")][-2:] != [MARK, MARK + "x"] or sp.decode(sp.encode("Ａ  x")) != "Ａ  x":
        raise ValueError("only models with an identity normaliser are supported")
    return sp


def escape(array: pa.Array) -> pa.Array:
    """Literal U+2581 characters are spaces to the model."""
    array = array.cast(pa.large_string())
    if pc.any(pc.match_substring(array, MARK)).as_py():
        array = pc.replace_substring(array, MARK, " ")
    return array


class Units:
    """Units of one chunk: spans with the spaces before them, and lone space runs.

    ``row, start, end, spaces`` describe units in text order inside each row
    (newlines and space runs without a word included when ``ordered``).
    """

    def __init__(self, off: np.ndarray, buf: np.ndarray):
        n = len(buf) - 8
        body = buf[:n]
        self.buf, self.off = buf, off
        starts, ends, first = X.split(off, buf, SEPARATOR)
        rows = np.repeat(np.arange(len(off) - 1), np.diff(first))
        begin = off[:-1]
        space = body == 32
        prev = np.maximum.accumulate(np.where(space, -1, np.arange(n))) if n else np.zeros(0, np.int64)

        def before(at: np.ndarray, row: np.ndarray) -> np.ndarray:
            """Spaces straight before ``at`` in its row, with the dummy one."""
            p = np.where(at > 0, prev[np.maximum(at - 1, 0)], -1) if n else np.full(len(at), -1)
            floor = begin[row] - 1
            p = np.maximum(p, floor)
            return at - 1 - p + (p == floor)

        self.rows, self.starts, self.ends, self.first = rows, starts, ends, first
        self.spaces = before(starts, rows)
        # lone runs end at a newline or at the end of a row that isn't empty
        line = np.flatnonzero(body == 10)
        line_row = np.searchsorted(off, line, "right") - 1
        filled = np.flatnonzero(np.diff(off) > 0)
        at, row = np.concatenate([line, off[filled + 1]]), np.concatenate([line_row, filled])
        k = before(at, row)
        # the end of a row whose last character is a word's or a newline has no run
        lone = k > 0
        self.lone_rows, self.lone_at, self.lone_spaces = row[lone], at[lone], k[lone]
        self.line_rows, self.lines = line_row, line

    def hashes(self) -> np.ndarray:
        h = X.hash_spans(self.buf, self.starts, self.ends)
        return X.mix(h ^ (self.spaces.astype(X.U64) * X.U64(0xA24BAED4963EE407)))

    def text(self, i: int) -> tuple[int, str]:
        return int(self.spaces[i]), self.buf[self.starts[i] : self.ends[i]].tobytes().decode("utf-8")


def encode_units(path: str, units: list[tuple[int, str]]) -> list[list[int]]:
    """Ids of each (spaces, word); the library adds one space itself."""
    sp = processor(path)
    out = sp.encode([" " * (k - 1) + w if k else "\n" + w for k, w in units], num_threads=1)
    return [ids if k else ids[2:] for (k, _), ids in zip(units, out)]


@lru_cache(maxsize=4096)
def run_ids(path: str, spaces: int) -> tuple[int, ...]:
    """Ids of a run of spaces without a word (``spaces`` includes the dummy)."""
    return tuple(processor(path).encode("\n" + " " * spaces + "\n")[2:-1])
