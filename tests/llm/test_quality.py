import collections

import numpy as np
import pytest

from lexloom.llm import kneser_ney as K, quality as Q, textnp as X, word_model as W
from tests.llm.helpers import NASTY, corpus, prose, words


def base(t):
    t = t or ""
    w = [x.decode("utf-8", "surrogatepass") for x in words(t)]
    lines = [x for x in t.split("\n") if words(x)]
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    mark = [0] * len(w)
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [1, 1, 1]
    failed = len(w) < 50 or 100 * sum(mark) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(mark), failed


def test_base_rules_by_brute_force(spark):
    rows = [(d, "en", t) for d, t in corpus(8) + NASTY] + [(900, None, "# * $ % & | < > " * 20)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()
    key = lambda x: tuple(map(str, x))
    mine = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=key)
    assert mine == sorted(((d, *base(t)) for d, _, t in rows), key=key)
    assert all(not r["kept"] for r in got if r["base_failed"])


def slow_model(texts):
    """Modified Kneser-Ney by dictionaries, one n-gram at a time."""
    grams = collections.Counter()
    for t in texts:
        for w in words(t):
            s = [K.EDGE] * 3 + list(w) + [K.EDGE]
            grams.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 512
        table = levels[k]
        d = K._discounts(np.array(list(table.values())))
        same = {x: c for x, c in table.items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        cut = lambda c: d[min(c, 3)]
        gamma = sum(cut(c) for c in same.values()) / total
        own = same.get(g, 0)
        return (own - cut(own) if own else 0.0) / total + gamma * p(g[1:])

    return grams, p


def test_model_equals_slow_model():
    texts = [" ".join(prose(300, s, 60)) for s in range(2)]
    grams, p = slow_model(texts)
    pack = lambda g: sum(x << (9 * (3 - i)) for i, x in enumerate(g))
    model = K.fit(np.array([pack(g) for g in grams]), np.array(list(grams.values())))
    rng = np.random.default_rng(0)
    asked = [*list(grams)[:60], *[tuple(int(x) for x in rng.integers(0, 257, 4)) for _ in range(40)], *[(*g[:3], 5) for g in list(grams)[:40]]]
    got = np.exp(model.log_prob(np.array([pack(g) for g in asked])))
    assert np.allclose(got, [p(g) for g in asked], rtol=1e-9)
    context = asked[0][:3]
    assert abs(np.exp(model.log_prob(np.array([pack((*context, x)) for x in range(512)]))).sum() - 1) < 1e-9


def test_perplexity_equals_slow_model(spark):
    rows = [(i, "en", " ".join(prose(80 + i, i, 60))) for i in range(6)]
    _, p = slow_model([t for _, _, t in rows])
    got = {r["doc_id"]: r["log_ppl"] for r in Q.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    for d, _, t in rows[:2]:
        logs = []
        for w in words(t):
            s = [K.EDGE] * 3 + list(w) + [K.EDGE]
            logs += [np.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)]
        assert abs(got[d] + np.mean(logs)) < 1e-9


@pytest.mark.parametrize("max_grams", [2_000_000, 500])
def test_odd_texts_are_rejected_and_prose_kept(spark, max_grams):
    import random

    r = random.Random(1)
    pool = prose(30_000, 1, 600)
    rows = [(i, ("en", "de", None)[i % 3], " ".join(r.sample(pool, 150))) for i in range(150)]
    rows += [(1000 + i, "en", " ".join("".join(r.choice("qxzjkvw%$#") for _ in range(9)) for _ in range(60))) for i in range(3)]
    got = {x["doc_id"]: x["kept"] for x in Q.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string"), max_grams=max_grams).collect()}
    assert sum(got[i] for i in range(150)) >= 147 and not any(got[1000 + i] for i in range(3))


def test_each_language_has_its_own_models(spark):
    """Seventy languages: as many byte models, and bands for each."""
    rows = [(100 * g + i, f"l{g}", " ".join(prose(80, g, 40)[i:])) for g in range(70) for i in range(6)]
    models = Q.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(models) == 70
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()
    assert len(got) == len(rows) and all(x["low"] is not None for x in got if not x["base_failed"])


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "en", "a b c", 5, "x", 7)], "doc_id long, lang string, text string, k int, key string, low int")
    assert Q.judge(rows).count() == 1
    assert Q.judge(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


def chains(seed=4):
    """Texts of chained words; then a shuffle of the first, and the second with glued symbols."""
    import random

    r = random.Random(seed)
    follow = {w: r.sample(range(200), 6) for w in range(200)}

    def chain(n):
        out = [r.randrange(200)]
        while len(out) < n:
            out.append(r.choice(follow[out[-1]]))
        return [f"w{chr(97 + x // 10)}{chr(97 + x % 10)}" for x in out]

    texts = [chain(120) for _ in range(120)]
    shuffled = r.sample(texts[0], 120)
    glued = [w + "###" if i % 2 else w for i, w in enumerate(texts[1])]
    return [(i, ("en", None)[i % 2], " ".join(t)) for i, t in enumerate(texts)] + [(900, "en", " ".join(shuffled)), (901, "en", " ".join(glued)), (902, "en", ""), (903, "xx", " ")]


def test_word_model_sees_order_and_spelling(spark):
    """A shuffle, or another symbol glued to each word, is odder."""
    got = {x["doc_id"]: x for x in Q.judge(spark.createDataFrame(chains(), "doc_id long, lang string, text string")).collect()}
    assert abs(got[900]["log_ppl"] - got[0]["log_ppl"]) < 1e-9  # the byte model alone can't tell
    assert got[900]["word_log_ppl"] > got[0]["word_log_ppl"] + 1
    assert not got[900]["kept"] and not got[901]["kept"] and sum(got[i]["kept"] for i in range(120)) >= 116


def slow_words(rows, models, split=None):
    """Leave-one-text-out Kneser-Ney by dictionaries; ``split`` words are cut in parts by the next word."""
    docs = {d: [(g, b"")] + [(g, w) for w in words(t)] for d, g, t in rows if words(t)}
    pairs = {d: [(s[i - 1], s[i]) for i in range(len(s))] for d, s in docs.items()}
    both = collections.Counter(p for x in pairs.values() for p in x)
    single = collections.Counter(v for v, _ in both.elements())
    cut = K._discounts(np.array(list(both.values())))
    gamma = collections.Counter()
    for (v, _), n in both.items():
        gamma[v] += cut[min(n, 3)]
    out = {}
    for d, own in pairs.items():
        mine, mine_v, total = collections.Counter(own), collections.Counter(v for v, _ in own), 0.0
        for v, w in own:
            if w[1]:
                buf = np.frombuffer(w[1] + b"\0" * 8, np.uint8)
                b = K.word_logs(models.get(w[0]), buf, np.array([0]), np.array([len(w[1])]))[0]
            else:
                b = 0.0
            b = np.exp(-np.round(-b * W._STEPS) / W._STEPS)
            left, rest = both[v, w] - mine[v, w], single[v] - mine_v[v]
            total += np.log((left - cut[min(left, 3)] if left else 0.0) / rest + gamma[v] / single[v] * b if rest else b)
        out[d] = -total / len(own)
    return out


def test_words_equal_slow_words(spark):
    rows = chains(5)[:40] + [(500 + d, "fr", t) for d, t in corpus(3)[:20]] + [(700 + d, "de", t) for d, t in NASTY if d not in (None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    models = Q.fit(docs)
    want = slow_words(rows, models)
    got = {x["doc_id"]: x["word_log_ppl"] for x in Q.judge(docs).collect()}
    assert all(abs(got[d] - x) < 1e-4 for d, x in want.items()) and len(want) > 60
    # many partitions: other discounts in each, hot contexts in parts; close to the same
    many = {x["doc_id"]: x["word_log_ppl"] for x in Q.judge(docs.repartition(3), part_tokens=2_000, hot_tokens=400, split_tokens=150).collect()}
    total, hot, counts = W.hot_contexts(docs.repartition(3).select("doc_id", "lang", "text"), 400)
    often = collections.Counter((g, w) for _, g, t in rows if words(t) for w in [b"", *words(t)])
    assert sorted(counts) == sorted(n for n in often.values() if n > 400) and len(hot) == len(counts) >= 2 and total == sum(len(words(t)) + 1 for _, _, t in rows if words(t))
    assert np.mean([abs(many[d] - x) for d, x in want.items()]) < 0.15


def test_split_contexts_keep_their_counts():
    """The mark's context is split by word: its parts share the whole count."""
    v, w = np.full(4, 77, X.U64), np.arange(4, dtype=X.U64) << X.U64(50)
    key, _ = W.keys_of(w, v, np.array([77], X.U64), np.array([4_000]), 1_000)
    context = key >> X.U64(W._WORD_BITS)
    assert ((context & W._SPLIT) > 0).all() and (((context & ~W._SPLIT) >> X.U64(W._PART_BITS)) == 0).all()
    plain, _ = W.keys_of(w, v, np.zeros(0, X.U64), np.zeros(0, np.int64), 1_000)
    assert len(set(plain >> X.U64(W._WORD_BITS))) == 1 and not (plain >> X.U64(W._WORD_BITS) & W._SPLIT).any()


def test_keys_round_trip():
    r = np.random.default_rng(2)
    key = np.unique((r.integers(0, 50, 900).astype(X.U64) << X.U64(58)) | (r.zipf(1.2, 900) % (1 << 24)).astype(X.U64))
    back = (key & W._WORD).astype(np.uint16)  # a value a word
    for n in (len(key), 1):
        got = W.unpack_keys(*W.pack_keys(key[:n], back[:n]))
        assert (got[0] == key[:n]).all() and (got[1] == back[:n]).all()


@pytest.mark.parametrize("kind", [np.uint16, np.float32, np.uint64])
def test_planes_round_trip(kind):
    for n in (0, 1, 1000):
        a = np.random.default_rng(n).integers(0, 60_000, n).astype(kind)
        assert (W.unsqueeze(W.squeeze(a), kind) == a).all()


def test_models_too_large_to_gather_are_whole(spark):
    """With more n-grams than are gathered, every result is what it is with fewer."""
    rows = chains(7)[:60] + [(500 + d, "fr", t) for d, t in corpus(3)[:20]] + [(700, None, "é世 " * 60), (701, "de", "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    whole, spread = ({x["doc_id"]: x for x in Q.judge(docs, **m).collect()} for m in ({}, {"max_grams": 50}))
    assert whole.keys() == spread.keys()
    for d, x in whole.items():
        assert abs(x["log_ppl"] - spread[d]["log_ppl"]) < 1e-9 and abs((x["word_log_ppl"] or 0) - (spread[d]["word_log_ppl"] or 0)) < 1e-9
        assert x["kept"] == spread[d]["kept"]


def test_very_long_words_keep_their_weight(spark):
    """A word that the byte model gives less than the least double, and one beyond 16,384 nats."""
    import random

    r = random.Random(2)
    pool = prose(3_000, 1, 200)
    rows = [(i, "en", " ".join(r.sample(pool, 100))) for i in range(30)]
    rows += [(100 + i, "en", " ".join([*r.sample(pool, 100), "".join(chr(r.randrange(33, 127)) for _ in range(n))])) for i, n in enumerate((400, 9_000, 36_000))]
    got = {x["doc_id"]: x["word_log_ppl"] for x in Q.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert got[0] + 3 < got[100] < got[101] / 5 and 3 * got[101] < got[102] < 5 * got[101]
