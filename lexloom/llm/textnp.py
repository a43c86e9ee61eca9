"""Vectorised word splitting and hashing over Arrow string buffers.

Everything here works on whole Arrow batches with numpy, so the Python
workers never loop over words.  A *word* is a maximal run of bytes other than
space and TAB..CR (``[^\\x20\\x09-\\x0D]+``); because UTF-8 continuation bytes
are never in that class, byte-level splitting equals code-point splitting.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_LANE = U64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


def lean(least: int = 1 << 20) -> None:
    """Give free memory back to the system now, and arrays of over ``least`` bytes as soon as they are freed.

    Workers are used again by the steps that follow, and keep what glibc and Arrow hold back for reuse.
    """
    try:
        libc = ctypes.CDLL("libc.so.6")
        for option in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(option, least)
        pa.default_memory_pool().release_unused()
        pa.set_memory_pool(pa.system_memory_pool())
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to tune
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection on uint64)."""
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=U64))[0])


def chunks(array: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array in row ranges of about ``max_bytes``.

    Yields ``(first_row, last_row, offsets, bytes)`` with offsets relative to
    the bytes, which carry 8 bytes of zero padding.  Nulls are empty texts.
    A single text longer than ``max_bytes`` is a chunk by itself: texts are
    never cut.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    n = len(array)
    if n == 0:
        return
    _, offs, data = array.buffers()
    off = np.frombuffer(offs, dtype=np.int64, count=n + 1, offset=8 * array.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if array.null_count:
        # a null slot may span bytes in theory; rebuild it as an empty text
        array = array.fill_null("")
        _, offs, data = array.buffers()
        off = np.frombuffer(offs, dtype=np.int64, count=n + 1, offset=8 * array.offset)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        buf = np.zeros(int(off[hi] - off[lo]) + 8, np.uint8)
        buf[:-8] = raw[off[lo] : off[hi]]
        yield lo, hi, off[lo : hi + 1] - off[lo], buf
        lo = hi


def split(off: np.ndarray, buf: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, per row, the index of its first word."""
    n = len(buf) - 8
    word = ~sep[buf[:n]]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, read in 8-byte lanes."""
    lanes = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    left = ends - starts
    h = (left.astype(U64) + U64(1)) * _LANE
    if not len(starts):
        return h
    at, live = starts, None
    while True:
        v = lanes[at] & _KEEP[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ v)
        else:
            h[live] = mix((h[live] + _LANE) ^ v)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of every n consecutive values (len(h)-n+1)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    acc = np.zeros(m, U64)
    with np.errstate(over="ignore"):
        mul = U64(1)
        for k in range(n):
            acc += h[k : k + m] * mul
            mul = U64((int(mul) * 0xD6E8FEB86659FD93) & (2**64 - 1))
    return mix(acc)


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of n-word windows that stay within one row, and their rows."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    rows = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][rows]
    return at, rows


def python_words(text: str | None) -> list[bytes]:
    """The same words one text at a time (bytes.split has this very class)."""
    return (text or "").encode("utf-8", "surrogatepass").split()
