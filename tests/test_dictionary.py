"""Counts of listed words against plain loops, with a broadcast list and with a joined one."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import dictionary


@pytest.mark.parametrize("small", [10_000, 0])
@pytest.mark.parametrize("parts", [False, True])
def test_count_listed(spark, small, parts):
    rng = random.Random(1)
    pool = ["the", "The", "cat", "well-known", "half-xyz", "xyz-abc", "-", "a--b", "ÉTÉ", "odd", "xyz"]
    rows = [(i, [rng.choice(pool) for _ in range(rng.randint(0, 30))]) for i in range(80)] + [(90, None), (91, ["the"] * 2000), (None, ["the", "cat"])]
    listed = ["the", "cat", "known", "half", "b", "été", "the", None, "y" * 200]
    words = spark.createDataFrame([(w,) for w in listed], "word string")
    df = spark.createDataFrame(rows, "id long, tokens array<string>").withColumns({"word": F.lit("x"), "pos": F.lit(1), "n": F.lit(2)})
    got = {r.id: r.n_listed for r in dictionary.count_listed(df, "id", F.col("tokens"), words, parts, small).collect()}
    held = {w for w in listed if w}
    want = {}
    for k, tokens in rows:
        n = sum(any(p in held for p in (t.lower().split("-") if parts else [t.lower()])) for t in tokens or [])
        if n:
            want[k] = n
    assert got == want
    whole = dictionary.with_listed(df, "id", F.col("tokens"), words, {"k": F.size("tokens")}, parts).collect()
    assert {r.id: r.n_listed for r in whole if r.id is not None} == {k: want.get(k, 0) for k, _ in rows if k is not None}
    assert dictionary.count_listed(df.limit(0), "id", F.col("tokens"), words).count() == 0


@pytest.mark.parametrize("parts", [False, True])
def test_only_tokens_of_rare_words_are_shuffled(spark, monkeypatch, parts):
    rng = random.Random(2)
    pool = ["the", "Of", "zzz", "well-known", "the-zzz"] * 40 + [f"w{i}" for i in range(200)] + ["w5-w7", "zzz-w9", "y" * 200]
    rows = [(i, [rng.choice(pool) for _ in range(300)]) for i in range(40)] + [(50, []), (51, None), (52, ["w1"] * 500)]
    held = {"the", "known", *(f"w{i}" for i in range(0, 200, 3))}
    words = spark.createDataFrame([(w,) for w in sorted(held)], "word string")
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    tables = {}
    put = dictionary.written
    monkeypatch.setattr(dictionary, "written", lambda t, name: tables.setdefault(name, put(t, name)))
    monkeypatch.setattr(dictionary, "SMALL", 20)
    got = {r.id: r.n_listed for r in dictionary.count_listed(df, "id", F.col("tokens"), words, parts, 0).collect()}
    want = {k: sum(any(p in held for p in (t.lower().split("-") if parts else [t.lower()])) for t in tokens or []) for k, tokens in rows}
    assert got == {k: n for k, n in want.items() if n}
    left = {r.word: r.n for r in tables["settled-tokens"].where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    assert "y" * 200 in left and 100 < len(left) < 210 and not left.keys() & {"the", "of", "zzz", "w1"}
    assert sum(left.values()) < sum(len(t or []) for _, t in rows) / 2


@pytest.mark.parametrize("small", [10_000, 2, 0])
@pytest.mark.parametrize("parts", [False, True])
def test_long_words_of_the_list_count(spark, small, parts):
    long, longer = "x" * 150, "z" * 5000
    listed = ["the", long] if small == 2 else ["the", long, longer]
    rows = [(1, [long, longer.upper(), "the", "y" * 150]), (2, [f"the-{long}", f"odd-{longer}"]), (3, [long] * 500), (4, ["y" * 150])]
    words = spark.createDataFrame([(w,) for w in listed], "word string")
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r.id: r.n_listed for r in dictionary.count_listed(df, "id", F.col("tokens"), words, parts, small).collect()}
    want = {k: sum(any(p in listed for p in (t.lower().split("-") if parts else [t.lower()])) for t in tokens) for k, tokens in rows}
    assert got == {k: n for k, n in want.items() if n} and got[3] == 500
