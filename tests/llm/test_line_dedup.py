import collections

from lexloom.llm import line_dedup as L, textnp as X
from tests.llm.helpers import NASTY, corpus
import numpy as np
import pyarrow as pa


def chunks_of(text):
    """(first line, lines) of each chunk, one line at a time."""
    lines = [x.encode("utf-8", "surrogatepass") for x in text.split("\n")]
    h = []
    for line in lines:
        buf = np.frombuffer(line + b"\0" * 8, np.uint8)
        h.append(int(X.hash_spans(buf, np.array([0]), np.array([len(line)]))[0]))
    out, begin = [], 0
    for i in range(len(lines)):
        roll = (h[i] + (h[i - 1] * int(L._ROLL) if i else 0)) % 2**64
        if X.mix_int(roll) % L.DIVISOR == 0 or i == len(lines) - 1:
            out.append((begin, lines[begin : i + 1]))
            begin = i + 1
    return out


def brute(rows):
    """Removed (line, n) spans of each distinct (id, text)."""
    places = collections.defaultdict(set)
    for d, t in rows:
        for line, c in chunks_of(t or ""):
            if len(c) >= L.MIN_LINES:
                places[tuple(c)].add((d is None, d or 0, t, line))
    out = collections.defaultdict(list)
    for c, where in places.items():
        if len(where) > 1:
            ids = sorted(where, key=lambda p: (p[0], p[1]))
            first = ids[0]
            ties = [p for p in ids if p[:2] == first[:2]]
            for none, d, t, line in where:
                out[(None if none else d, t)].append((line, len(c), len(ties) > 1))
    return out, places


def run(spark, rows):
    return L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_equals_brute_force(spark):
    rows = [r for r in corpus(3, 80) if r[0]] + [r for r in NASTY if r[0] != 8]
    spans, places = brute(rows)
    firsts = {c: min(w, key=lambda p: (p[0], p[1], p[3])) for c, w in places.items() if len(w) > 1}
    removed = 0
    for r in run(spark, rows):
        mine = [(s["line"], s["n"]) for s in r["spans"]]
        text = next(t for d, t in rows if d == r["doc_id"] and (t is None) == (r["text"] is None) and (t or "").count("\n") + 1 == (r["n_lines"] or 1))
        want = []
        for line, c in chunks_of(text or ""):
            at = (r["doc_id"] is None, r["doc_id"] or 0, text, line)
            if tuple(c) in firsts and at in places[tuple(c)] and at != firsts[tuple(c)]:
                want.append((line, len(c)))
        assert mine == want, r["doc_id"]
        removed += r["n_removed"]
        if text is not None:
            gone = {i for line, n in mine for i in range(line, line + n)}
            assert r["text"] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            assert r["n_lines"] == text.count("\n") + 1 and r["n_removed"] == len(gone)
        else:
            assert r["text"] is None and r["n_lines"] == 0
    assert removed > 100


def test_repeated_rows_are_one_document(spark):
    text = "\n".join(f"line {i} of it" for i in range(40))
    got = run(spark, [(1, text), (1, text), (2, text), (1, "other"), (None, text)])
    kept = sorted((str(r["doc_id"]), r["n_removed"]) for r in got)
    multi = sum(len(c) for _, c in chunks_of(text) if len(c) >= L.MIN_LINES)
    assert kept == [("1", 0), ("1", 0), ("1", 0), ("2", multi), ("None", multi)]
    assert len({r["text"] for r in got if r["doc_id"] == 1}) == 2


def test_boundaries_come_back_after_an_insertion():
    lines = [f"some line number {i}" for i in range(200)]
    a = {tuple(c) for _, c in chunks_of("\n".join(lines))}
    b = {tuple(c) for _, c in chunks_of("\n".join([*lines[:90], "inserted", *lines[90:]]))}
    assert len(a - b) <= 2 and len(b - a) <= 3


def test_collisions_compare_bytes(spark, monkeypatch):
    """Keys forced to agree: only equal bytes are removed."""
    real = L.chunk_table

    def same_key(off, buf, *how):
        out = list(real(off, buf, *how))
        out[5], out[6] = out[5] * 0, out[6] * 0
        return tuple(out)

    texts = ["\n".join(f"t{k} line {i}" for i in range(30)) for k in (0, 1, 0)]
    want = sum(len(c) for _, c in chunks_of(texts[0]) if len(c) >= L.MIN_LINES)
    off = np.cumsum([0, *[len(t) for t in texts]])
    assert len(real(off, np.frombuffer("".join(texts).encode() + b"\0" * 8, np.uint8))[0]) >= 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = L.dedup(rows)
    assert {r["doc_id"]: r["n_removed"] for r in df.collect()} == {0: 0, 1: 0, 2: want}


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a\nb", "k", 5, "x", 7)], "doc_id long, text string, d string, spans int, t string, n long")
    r = L.dedup(df).first()
    assert (r["d"], r["t"], r["n"], r["spans"], r["text"]) == ("k", "x", 7, [], "a\nb")


def test_lines_of_many_rows():
    texts = ["", "a", "a\n", "\n", "\n\nb\n", "c\r\nd"]
    for lo, hi, off, buf in X.chunks(pa.array(texts)):
        s, e, first = L.lines(off, buf)
        got = [[bytes(buf[s[i] : e[i]]).decode() for i in range(first[r], first[r + 1])] for r in range(hi - lo)]
        assert got == [t.split("\n") for t in texts]


def test_whole_runs_go_to_their_full_length(spark):
    """Every line under two neighbouring lines that stand earlier, by dictionaries."""
    shared = [f"shared {i}" for i in range(5)]
    rows = [(d, "\n".join([f"head {d}", *shared[d % 3 :], f"tail {d}", f"end {d}"])) for d in range(12)]
    rows += [(d, t) for d, t in corpus(3, 80) if d] + [(900, "a\na\na\na\na"), (901, "x\n\n\n\ny"), (902, "x\n\n\n\ny"), (903, None), (904, "one"), (None, rows[0][1])]
    first, want = {}, {}
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            at = first.setdefault(pair, (d, i))
            if at != (d, i) and (at[0] != d or i >= at[1] + 2):
                gone |= {i, i + 1}
        want[d] = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    got = {r["doc_id"]: r for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole_runs=True).collect()}
    assert {d: (r["text"], r["n_removed"]) for d, r in got.items()} == want
    assert got[3]["text"] == "head 3\ntail 3\nend 3" and got[900]["text"] == "a\na"
    assert all(sum(s["n"] for s in r["spans"]) == r["n_removed"] for r in got.values())
