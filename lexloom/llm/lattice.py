"""The piece lattice of many words at a time, in numpy.

The same three steps as the relational lattice of ``sentencepiece_lattice``: all
substrings that can be pieces are laid out, joined to the piece table by the hash of
their bytes, and the edges of each word are folded in order of merge rank.  The
fold takes the k-th edge of all words in one step.  Words may have any length.

Pieces of marks alone (runs of spaces) share one rank, the worst, and merge leftmost
first; one ordered pass can't follow that.  They come last of all merges, so they are
left out of the lattice, and the marks that no word took are cut up by themselves.
"""

from __future__ import annotations

import numpy as np

from lexloom.llm import pieces as P
from lexloom.llm import textnp as X


class Lattice:
    """Pieces of one BPE model, by the hash of their bytes."""

    def __init__(self, path: str, rows: list[tuple[str, int, float]]):
        sp = P.processor(path)
        place = {x: i for i, x in enumerate(sorted({x for _, _, x in rows}, reverse=True))}
        known: dict[bytes, tuple[int, int]] = {}
        marks = {len(p): i for p, i, _ in rows if not p.strip(P.MARK)}
        scores = [place[x] for p, _, x in rows if len(p) > 1 and p.strip(P.MARK)]
        merged = [place[x] for p, _, x in rows if len(p) > 1 and not p.strip(P.MARK)]
        if len(scores) > len(set(scores)) or (merged and min(merged) < max(scores, default=0)) or any(p.startswith(P.MARK * 2) and p.strip(P.MARK) for p, _, _ in rows):
            raise ValueError("pieces that tie, or marks that merge before words do, are not supported")
        self.mark, self.marks, self.cut_runs = marks.get(1, -1), marks, {}
        for p, i, x in rows:
            if len(p) > 1 and p.strip(P.MARK):
                known[p.encode()] = i, place[x]
                for k in range(2, len(p)):  # beginnings of pieces, so that hopeless substrings end early
                    known.setdefault(p[:k].encode(), (-1, 0))
        self.longest = max((len(p) for p, _, _ in rows), default=1)
        self.keys, self.ids, self.ranks = self._table(known)
        self.char_keys, self.char_ids, _ = self._table({p.encode(): (i, 0) for p, i, _ in rows if len(p) == 1})
        self.bytes = np.array([sp.piece_to_id(f"<0x{x:02X}>") for x in range(256)], np.int64)

    def run(self, m: int) -> list[int]:
        """Ids of m marks in a row: the leftmost pair that is a piece merges first."""
        if m not in self.cut_runs:
            most, out = max(self.marks, default=1), []
            if m > 3 * most:  # whole blocks of the longest piece come first
                out = [self.marks[most]] * ((m - 2 * most) // most)
            left = [1] * (m - most * len(out))
            while (i := next((i for i, (a, b) in enumerate(zip(left, left[1:])) if a + b in self.marks), None)) is not None:
                left[i : i + 2] = [left[i] + left[i + 1]]
            if len(self.cut_runs) > 4096:
                self.cut_runs.clear()
            self.cut_runs[m] = out + [self.marks[x] for x in left]
        return self.cut_runs[m]

    @staticmethod
    def _table(known: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(k) for k in known], np.int64)
        ends = np.cumsum(size)
        h = X.hash_spans(np.frombuffer(b"".join(known) + b"\0" * 8, np.uint8), ends - size, ends)
        order = np.argsort(h)
        value = np.array(list(known.values()), np.int64).reshape(-1, 2)[order]
        return h[order], value[:, 0], value[:, 1]

    @staticmethod
    def _find(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        slot = np.minimum(np.searchsorted(table, asked), len(table) - 1)
        return table[slot] == asked, slot

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and the number of each unit's."""
        words = len(starts)
        # text of each unit: a mark (three bytes) a space, then the word
        size = 3 * spaces + ends - starts
        base = np.cumsum(size) - size
        text = np.zeros(int(size.sum()) + 8, np.uint8)
        marks = np.repeat(base, spaces) + 3 * (np.arange(int(spaces.sum())) - np.repeat(np.cumsum(spaces) - spaces, spaces))
        for k, x in enumerate(P.MARK.encode()):
            text[marks + k] = x
        own = ends - starts
        inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        text[np.repeat(base + 3 * spaces, own) + inside] = buf[np.repeat(starts, own) + inside]
        at = np.flatnonzero((text[:-8] & 0xC0) != 0x80)
        word = np.searchsorted(base + size, at, "right")
        chars = np.bincount(word, minlength=words)
        last = np.cumsum(chars)  # first character behind each word
        edge = np.r_[at, len(text) - 8]
        # the lattice: start, length, rank and id of every piece that stands in a word
        live = np.arange(len(at))
        found: list[tuple[np.ndarray, ...]] = []
        for n in range(2, self.longest + 1):
            live = live[live + n <= last[word[live]]]
            if not len(live):
                break
            hit, slot = self._find(self.keys, X.hash_spans(text, edge[live], edge[live + n]))
            live, slot = live[hit], slot[hit]
            piece = self.ids[slot] >= 0
            found.append((live[piece], np.full(int(piece.sum()), n), self.ranks[slot[piece]], self.ids[slot[piece]]))
        start, length, rank, ids = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
        order = np.lexsort((start, rank, word[start]))
        start, length, ids = start[order], length[order], ids[order]
        of = word[start]
        # slots of cuts: one before each character and one behind each word
        slot = np.arange(len(at)) + word
        cut = np.ones(len(at) + words + self.longest, bool)
        many = np.bincount(of, minlength=words)
        first = np.cumsum(many) - many
        turn = np.argsort(-many, kind="stable")
        ahead = np.arange(1, max(self.longest, 2))
        fewer = -many[turn]
        for k in range(int(many.max()) if len(many) else 0):
            e = first[turn[: np.searchsorted(fewer, -k, "left")]] + k
            s, n = slot[start[e]], length[e]
            inner = cut[s[:, None] + ahead] & (ahead < n[:, None])
            merge = cut[s] & cut[s + n] & (inner.sum(axis=1) == 1)
            cut[(s + 1 + inner.argmax(axis=1))[merge]] = False
        s = slot[start]
        left = np.flatnonzero(cut[s] & cut[s + length])
        left = left[~(cut[s[left][:, None] + ahead] & (ahead < length[left][:, None])).any(axis=1)]
        piece_at = np.full(len(at), -1)
        piece_at[start[left]] = ids[left]
        # what is left: pieces, single characters, and bytes of characters without a piece
        head = np.flatnonzero(cut[slot])
        out = piece_at[head]
        alone = np.flatnonzero(out < 0)
        hit, c = self._find(self.char_keys, X.hash_spans(text, edge[head[alone]], edge[head[alone] + 1]))
        out[alone[hit]] = self.char_ids[c[hit]]
        width = np.where(out < 0, edge[head + 1] - edge[head], 1)
        flat = np.repeat(out, width)
        raw = np.flatnonzero(flat < 0)
        flat[raw] = self.bytes[text[(np.repeat(edge[head] - (np.cumsum(width) - width), width) + np.arange(len(flat)))[raw]]]
        flat, count = flat.astype(np.int32), np.bincount(word[head], width, words).astype(np.int64)
        several = np.flatnonzero(spaces > 1)
        if len(several):
            begin, parts, p = np.cumsum(count) - count, [], 0
            for w in several.tolist():
                own = flat[begin[w] : begin[w] + min(count[w], spaces[w])]
                m = len(own) if (own == self.mark).all() else int(np.argmin(own == self.mark))
                ids = self.run(m)
                parts += [flat[p : begin[w]], np.array(ids, np.int32)]
                p = begin[w] + m
                count[w] += len(ids) - m
            flat = np.concatenate([*parts, flat[p:]])
        return flat, count

