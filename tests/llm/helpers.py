"""Brute-force versions of the operators, and awkward rows."""

import collections
import random

NASTY = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four"), (6, "▁mark ▁▁ x\n\n y  "), (7, "naïve 世界 🙂 \x00   end"),
    (8, "same text repeated " * 40), (9, "same text repeated " * 40), (8, "same text repeated " * 40), (None, "no id but words " * 20), (None, None),
    (10, "x" * 3000), (11, "word " * 5000), (12, "a\n" * 500), (13, "line one\nline two\n\nline three\r\nline four"),
]


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return [names[min(int(r.expovariate(0.02)), vocabulary - 1)] for _ in range(n)]


def corpus(seed=0, n=60):
    """Prose with exact copies, near copies, shared passages and repeated lines."""
    r = random.Random(seed)
    passage = " ".join(prose(60, seed + 999))
    block = "\n".join(" ".join(prose(6, seed + 500 + i)) for i in range(8))
    out = []
    for i in range(n):
        w = prose(r.randint(5, 300), seed * 1000 + i)
        t = "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
        kind = r.random()
        if kind < 0.15 and out:
            t = r.choice(out)[1]
        elif kind < 0.3 and out:
            v = (r.choice(out)[1] or "").split(" ")
            for _ in range(max(1, len(v) // 40)):
                v[r.randrange(len(v))] = "changed"
            t = " ".join(v)
        elif kind < 0.45:
            t += " " + passage + " tail"
        elif kind < 0.6:
            t = t + "\n" + block + "\n" + t[:20]
        out.append((100 + i, t))
    return out


def repeats(rows, window):
    """Removal flags of each row, by counting every window."""
    count = collections.Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def shingles(text, n=5):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(rows, num=70, den=100):
    """Smallest reachable id of each id."""
    sets = {}
    for d, t in rows:
        sets.setdefault(d, set()).add(shingles(t))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(d, s) for d, ss in sets.items() for s in ss]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}
