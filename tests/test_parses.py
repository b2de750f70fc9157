"""Metrics of parsed sentences on hand-made trees."""

from pyspark.sql import functions as F

from scriptorium.operators.parses import parsed_metrics, sentence_counts

SCHEMA = "id int, sid int, row int, tokens array<struct<head int, relation string, tag string, lemma string>>"
# The old dog and the cat were chased because it rained .
TREE = [
    (2, "det", "DET", "the"),
    (2, "amod", "ADJ", "old"),
    (7, "nsubj:pass", "NOUN", "dog"),
    (2, "cc", "CCONJ", "and"),
    (5, "det", "DET", "the"),
    (2, "conj", "NOUN", "cat"),
    (7, "aux:pass", "AUX", "be"),
    (7, "ROOT", "VERB", "chase"),
    (10, "mark", "SCONJ", "because"),
    (10, "nsubj", "PRON", "it"),
    (7, "advcl", "VERB", "rain"),
    (7, "punct", "PUNCT", "."),
]


def test_parsed_sentences(spark):
    dog = [(h, "nsubj" if r == "nsubj:pass" else r, t, x) for h, r, t, x in TREE]
    nested = [(2, "poss", "NOUN", "a"), (0, "nsubj", "NOUN", "b"), (2, "ROOT", "NOUN", "c")]
    rows = [(1, 0, 5, TREE), (1, 1, 5, dog), (2, 2, 5, nested), (3, 3, 5, []), (4, 4, 5, None)]
    rows += [(5, 5, 5, [(9, None, None, None), (-1, "nsubj", "NOUN", "X")]), (6, 6, 5, [(max(i - 1, 0), "conj", "NOUN", "w") for i in range(3000)])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.sid: r for r in sentence_counts(df).collect()}
    assert set(got) == {0, 1, 2, 5, 6} and got[0].row == 5
    # In the first, dog is the passive subject under a name that begins no phrase, nor does cat joined to it; "it" does.
    assert (got[0].depth, got[0].clauses, got[0].passive, got[0].chunks, got[0].words, got[0].content) == (3, 1, 1, 1, 11, 5)
    # The dog, the cat joined to it, and it.
    assert (got[1].chunks, got[1].passive) == (3, 1)
    # b is a phrase; c begins before its end, so it is part of no new one.
    assert (got[2].chunks, got[2].depth) == (1, 2)
    # Heads outside are roots; nulls match nothing.
    assert (got[5].depth, got[5].chunks, got[5].words) == (0, 1, 2) and got[5].lemmas == ["x"]
    assert (got[6].depth, got[6].chunks) == (2999, 0)
    out = {r.id: r for r in parsed_metrics(df, "id").collect()}
    assert (out[1].sentences, out[1].parse_depth, out[1].ttr, out[1].np_density) == (2, 3.0, 0.5, round(4 / 22 + 1e-9, 6))
    assert set(out) == {1, 2, 5, 6} and parsed_metrics(df.where(F.lit(False)), "id").count() == 0


def test_batches_do_not_change_counts(spark, monkeypatch):
    import random

    from scriptorium.operators import parses

    rng = random.Random(4)
    rings = [[((i + 1) % n, "conj", "NOUN", "w") for i in range(n)] for n in (2, 5)]
    some = lambda n: [(rng.choice([None, -1, 99, *range(n)]), rng.choice(["conj", "nsubj", "det", None]), rng.choice(["NOUN", "VERB", None]), rng.choice("aBcİ")) for _ in range(n)]
    rows = [(i, i, 0, t) for i, t in enumerate([*rings, *[some(rng.randint(0, 12)) for _ in range(60)]])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(repr, sentence_counts(df).collect()))
    plan = sentence_counts(df)._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "MapInArrow" in plan
    monkeypatch.setattr(parses, "SOME", 7)
    monkeypatch.setattr(parses, "MANY", 20)
    assert sorted(map(repr, sentence_counts(df).collect())) == want
    got = {r.sid: r for r in sentence_counts(df).collect()}
    # A ring has no root: its depth is its size.
    assert (got[0].depth, got[1].depth) == (2, 5)
