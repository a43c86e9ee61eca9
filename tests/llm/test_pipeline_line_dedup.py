import corpus_pipeline as P
from tests.llm.helpers import corpus


def test_stage_removes_every_repeated_run_and_nothing_else(spark):
    """Lines under two neighbouring lines that stand earlier, by dictionaries."""
    rows = [(d, t, "en", "web", len(t)) for d, t in corpus(5, 80)]
    first, want = {}, {}
    for d, t, *_ in rows:
        lines, gone = t.split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            at = first.setdefault(pair, (d, i))
            if at != (d, i) and (at[0] != d or i >= at[1] + 2):
                gone |= {i, i + 1}
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want[d] = kept, len(kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.drop_repeated_lines(spark, docs, "").collect()}
    assert got == want and sum(len(t) for _, t, *_ in rows) > sum(n for _, n in got.values())
