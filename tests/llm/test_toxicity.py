import random

from lexloom.llm import queries, toxicity as X
from tests.llm.helpers import NASTY, prose


def test_folding():
    assert X.fold("1D10T, іdiоt!") == " idiot  idiot  "
    assert X.fold("Ｓｃｕｍ\u200b z$@") == " scum zsa "
    assert X.fold(None) == X.fold("") == "  "


def matched(model, folded):
    """Every place, every entry: the slow way."""
    total = places = 0
    for at in range(len(folded)):
        if any(folded.startswith(p, at) for p in model.exceptions):
            continue
        best = max([w for p, w in model.lexicon.items() if folded.startswith(p, at)], default=0)
        total, places = total + best, places + (best > 0)
    return total, places


def test_matching_by_brute_force():
    r = random.Random(0)
    model = X.Model({" bad": 2.0, " badly ": 3.0, " ab ": 1.0, " abba": 1.5}, [" badge ", " abbas "])
    words = ["bad", "badly", "badge", "badger", "ab", "abba", "abbas", "ok", "xbad"]
    for _ in range(200):
        folded = X.fold(" ".join(r.choice(words) for _ in range(r.randint(0, 12))))
        got = X.match(model.automaton(), folded)
        assert got[1] == matched(model, folded)[1] and abs(got[0] - matched(model, folded)[0]) < 1e-9


def test_scores_are_monotone_in_evidence_and_length():
    c = X.Model({}).curve
    assert X.curve_score(c, 0, 100) < X.curve_score(c, 4, 100) < X.curve_score(c, 8, 100)
    assert X.curve_score(c, 4, 50) > X.curve_score(c, 4, 5000)
    assert 0 <= X.curve_score(c, 0, 0) <= 1 and 0 <= X.curve_score(c, 1e9, 1) <= 1


def test_learning_and_cases(spark):
    r = random.Random(1)
    docs = [(i, " ".join(prose(60, i)) + (" grumphole " + r.choice(["GRUMPH0LE", "grumpholes"]) if i % 3 == 0 else "")) for i in range(90)]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None), (12345, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = X.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(p.startswith(" grum") for p in model.lexicon)
    probe = NASTY + [(500, "what a grumphole"), (501, "plain words only")]
    got = X.score(spark.createDataFrame([(*p, 1.5) for p in probe], "doc_id long, text string, score double"), model).collect()
    assert len(got) == len(probe) and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got)
    by = {g["doc_id"]: g for g in got}
    assert by[500]["predicted"] == 1 and by[501]["predicted"] == 0 and by[1]["predicted"] == 0
    assert X.score(d.where("false"), model).count() == 0


def test_without_labels_a_seed_lexicon_serves(spark):
    d = spark.createDataFrame([(1, "you stupid 1d10t moron scum"), (2, "fine")], "doc_id long, text string")
    model = X.learn(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [g["predicted"] for g in X.score(d, model).orderBy("doc_id").collect()] == [1, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"  # about 100 held-out toxic rows; the smaller tables have six
    got = queries.op1_toxicity(spark, sf).where("held_out").select("doc_id", "score", "predicted")
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert len(both) > 500
    toxic, clean = both[both.toxic == 1], both[both.toxic == 0]
    assert toxic.predicted.mean() >= 0.85 and clean.predicted.mean() <= 0.02


def learnt(spark, toxic, clean):
    rows = [(i, t, 1) for i, t in enumerate(toxic)] + [(1000 + i, t, 0) for i, t in enumerate(clean)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return X.learn(d.select("doc_id", "text"), d.select("doc_id", "toxic"))


def test_clean_words_under_a_heavy_prefix_are_spared(spark):
    fill = [" ".join(prose(30, i)) for i in range(80)]
    toxic = [f"{fill[i]} {w}" for i, w in enumerate(["scumbag", "scummy"] * 10)]
    clean = [f"{fill[20 + i]} scumble" if i < 3 else fill[20 + i] for i in range(60)]
    model = learnt(spark, toxic, clean)
    assert any(p.startswith(" scum") and not p.endswith(" ") for p in model.lexicon) and " scumble " in model.exceptions
    match = lambda t: X.match(model.automaton(), X.fold(t))[1]
    assert match("a scumble here") == 0 and match("a scumbag here") == 1


def test_phrases_that_clean_texts_hold_are_spared(spark):
    fill = [" ".join(prose(30, i)) for i in range(160)]
    toxic = [fill[i] + " zounds you" for i in range(40)]
    clean = [fill[40 + i] + (" zounds river flows" if i < 6 else "") for i in range(120)]
    model = learnt(spark, toxic, clean)
    assert " zounds " in model.lexicon or any(p.startswith(" zou") for p in model.lexicon)
    assert " zounds river " in model.exceptions
    assert X.match(model.automaton(), X.fold("zounds river")) == (0.0, 0) and X.match(model.automaton(), X.fold("zounds you"))[1] >= 1


def test_few_labels_teach_a_few_words(spark):
    clean = [" ".join(prose(30, i)) for i in range(40)]
    model = learnt(spark, ["grumphole one", "two grumphole", "my grumphole"], clean)
    assert model.lexicon and all(p.startswith(" grum") for p in model.lexicon)
    nothing = learnt(spark, ["", None], clean)
    assert nothing.lexicon == {} and X.match(nothing.automaton(), " any ") == (0.0, 0)
