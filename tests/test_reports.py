import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import judge as J
from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.functions.validation import violations
from scriptorium.operators import matching as M
from scriptorium.operators import ranks as K
from scriptorium.operators import stats as S
from scriptorium.sources import fulltext

LISTS = [L.HEDGING, L.SIGNPOSTING, *L.HYPE.values(), ",".join(L.HYPE.values())]


def cued_texts(n=300, seed=4):
    rng = random.Random(seed)
    cues = [c.replace(".?", "-").replace("s?", "s") for text in LISTS for c in L.words(text)]
    glue = [" ", "  ", "\n", ", ", ". ", "-", "_", "é", "x", ""]
    return ["".join(rng.choice(cues + ["word", "ab", "7"]) + rng.choice(glue) for _ in range(30)) for _ in range(n)]


@pytest.mark.parametrize("text", LISTS)
def test_branched_patterns_match_what_plain_ones_match(text):
    for t in cued_texts():
        assert re.findall(L.branched(text), t) == re.findall(L.alternation(text), t)


def test_hype_in_one_scan(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cued_texts())], "id int, t string")
    low = F.lower("t")
    one = df.withColumn("found", T.hype_words(F.col("t"))).select("id", *[c.alias(k) for k, c in T.hype(F.col("found")).items()])
    each = df.select("id", *[T.count(low, T.U + L.alternation(v)).alias(f"hype_{k}") for k, v in L.HYPE.items()])
    assert S.same_rows(one, each).first()[2:] == (0, 0) and one.where("hype_rigor > 0").count() > 20


def test_squeeze(spark):
    texts = ["", " ", "a b", "a  b", "\ta\n b  c  d", " \n ", "a\r\n\r\nb "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.squeeze(F.col("t"))).collect()] == [" ".join(t.split()) for t in texts]


def test_preprocess_headings(spark):
    rows = ["METHODS: we do", "no colon METHODS", "ABSTRACT: x", "aABSTRACT: x", "p ± q +/- r", "a ( b ) c &amp; d & e < f"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r[0] for r in df.select(T.preprocess(F.col("t"))).collect()]
    want = ["we do", "no colon METHODS", "x", "aABSTRACT: x", "p plus or minus q plus or minus r", "a (b) c and d and e less than f"]
    assert got == want


def test_tree_depth(spark):
    rng = random.Random(2)
    trees = [[], [0], [1, 1, 0], [*range(1, 40), 39]] + [[rng.randint(0, i) for i in range(n)] for n in range(1, 30)]

    def plain(heads):
        def depth(i):
            return 0 if heads[i] == i else 1 + depth(heads[i])

        return max(map(depth, range(len(heads))), default=0)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(trees)], "id int, h array<int>")
    got = {r.id: r.d for r in df.select("id", J.tree_depth(F.col("h")).alias("d")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(trees)}


def test_pooled_rank_within_keys(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.choice("ab"), rng.choice([None, *range(30)])) for i in range(400)], "id int, k string, v int")
    got = K.pooled_rank(df, "v", keys=("k",)).toPandas()
    assert np.allclose(got["rank"].to_numpy(float), got.groupby("k").v.rank().to_numpy(), equal_nan=True)


def test_ranked(spark):
    df = spark.createDataFrame([(i, i % 3, i * 37 % 100) for i in range(100)], "id int, k int, v int")
    got = K.ranked(df, ["v", "id"], ["k"]).toPandas().sort_values(["k", "v"])
    want = got.groupby("k").cumcount() + 1
    assert (got["rank"] == want).all() and (got.n == got.groupby("k").id.transform("size")).all()


def test_spearman_by_range_agrees(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 20), rng.random()) for _ in range(300)], "k string, x int, y double")
    one, two = ({r.k: (r.n, round(r.rho, 9)) for r in S.spearman(df, "x", "y", ["k"], large=f).collect()} for f in (False, True))
    assert one == two


def test_violations(spark):
    rows = [
        ("1", "neurips", 2000, "t", "a b c d e", ["A"], None, None, []),
        ("2", "arxiv", 2000, "t", "a b c d e", ["A"], ["cs"], "cs", []),
        (" ", "xyz", 1986, " ", "a b", [], ["cs"], None, ["paper_id", "venue", "year", "title", "abstract", "authors", "arxiv"]),
        ("4", "arxiv", 2031, "t", "a b c d e", ["A", " "], None, None, ["year", "authors", "arxiv"]),
        (None, None, None, None, None, None, None, None, ["paper_id", "venue", "year", "title", "abstract", "authors"]),
    ]
    df = spark.createDataFrame(rows, "i string, v string, y int, t string, a string, n array<string>, c array<string>, p string, want array<string>")
    got = df.select(violations(*[F.col(c) for c in "ivytancp"]).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_same_numbers(spark):
    ref = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), "y"), (3, None, "z")], "k int, v double, s string")
    assert S.same_numbers(ref, ref, ["k"]).first().ok
    other = ref.withColumn("s", F.lit("other")).withColumn("more", F.lit(1))
    assert S.same_numbers(ref, other, ["k"]).first().ok  # text is not compared, and more columns do no harm
    off = ref.withColumn("v", F.col("v") + 0.01)
    assert S.same_numbers(ref, off, ["k"]).first().n_off == 1 and S.same_numbers(ref, off, ["k"], atol=0.1).first().ok
    assert not S.same_numbers(ref, ref.where("k < 3"), ["k"]).first().ok
    assert S.same_numbers(ref, ref.drop("v"), ["k"]).first().lacking == "v"


def test_patched(spark):
    long = " ".join(f"w{i}" for i in range(30))
    papers = spark.createDataFrame([(1, "short"), (2, "short"), (3, long), (4, None), (5, "kept as it is")], "id int, t string")
    cache = spark.createDataFrame([(1, "too few"), (2, "now of five words here"), (3, "a b c d e f")], "id int, new string")
    more = spark.createDataFrame([(1, 2, long + " second"), (1, 1, long), (2, 1, "few"), (4, 1, long)], "id int, o int, new string")
    got = {r.id: (r.t, r.patched) for r in M.patched(papers, cache, more, "id", "t", "o").collect()}
    assert got == {1: (long, True), 2: ("now of five words here", True), 3: ("a b c d e f", True), 4: (long, True), 5: ("kept as it is", False)}


def test_tei_odd_documents():
    head, tail = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text>', "</text></TEI>"
    read = lambda x: fulltext.parse_tei(f"{head}{x}{tail}")
    assert read("<body/>") is None and read("<front><p>x</p></front>") is None and fulltext.parse_tei("<html><body/></html>") is None
    got = read("<body><p>outside</p><div><head>One</head><head>Two</head><p>a <ref>b</ref>\n c</p><note>n</note><div><p>inner</p></div><p/><p>d</p></div><div><head/></div></body>")
    assert got["sections"] == [{"heading": "One", "text": "a b c d"}]
    got = read('<body><div><p>x</p><figure><head>Figure 2</head><figDesc>figure 2 is</figDesc></figure><figure><head>T</head></figure><ptr target=""/></div></body>')
    assert got["figure_captions"] == ["figure 2 is"] and got["urls"] == []


def test_lists_have_no_empty_word():
    assert all(w for text in itertools.chain(LISTS, L.CLAIMS.values(), L.ROLES.values()) for w in L.words(text))
    assert not pd.Series(L.words(L.HEDGING)).duplicated().any()


def test_common_features_reads_every_score(spark):
    from scriptorium.plans.reports import common_features

    path = "/root/testdata/sf0.001"
    models = spark.read.parquet(f"{path}/events.parquet").select("event_type").distinct().count()
    assert {tuple(r) for r in common_features(spark, path).collect()} == {(k, models) for k in range(3)}


def test_tei_is_parsed_some_at_a_time(spark):
    xml = lambda i: f"<TEI xmlns='http://www.tei-c.org/ns/1.0'><text><body><div><head>H{i}</head><p>p {i}</p></div></body></text></TEI>"
    rows = [(i, None if i % 7 == 0 else xml(i) if i % 5 else "<TEI") for i in range(3 * fulltext.SOME + 1)]
    at = fulltext.read_tei(spark.createDataFrame(rows, "k long, x string").coalesce(1), "k", "x")
    assert "MapInArrow" in at._jdf.queryExecution().optimizedPlan().toString()
    for r in at.collect():
        want = fulltext.parse_tei(rows[r.k][1]) or {}
        assert (r.sections and [s.asDict() for s in r.sections], r.figure_captions, r.urls) == tuple(want.get(c) for c in ("sections", "figure_captions", "urls"))
    assert at.count() == len(rows)
