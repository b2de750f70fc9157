"""Relational operators, statistics, sources and incremental runs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import matching as M
from scriptorium.operators import ranks as K
from scriptorium.operators import sampling as P
from scriptorium.operators import stats as S
from scriptorium.sources import fulltext, html, tables


def test_terciles_match_quantile_cuts(spark):
    rows = [(n, i, float(i * 7919 % 101)) for n in (2, 3, 8, 10, 31) for i in range(n)]
    df = spark.createDataFrame(rows, "band int, id int, v double")
    got = K.terciles(df, "v", "id", "band").withColumnRenamed("tercile", "t").toPandas()
    for n, x in got.groupby("band"):
        x = x.sort_values(["v", "id"])
        want = [1] * n if n < 3 else pd.qcut(pd.Series(range(1, n + 1)), 3, labels=False).tolist()
        assert x.t.tolist() == want


def test_percentile_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), (None, 5.0)], "g string, v double")
    rows = K.percentiles(df, "v", "p", "g").collect()
    assert len(rows) == 5
    assert {(r.g, r.v): r.p for r in rows} == {("a", 1.0): pytest.approx(1 / 3), ("a", 2.0): pytest.approx(2.5 / 3), ("a", None): None, (None, 5.0): 1.0}
    assert K.percentiles(df.limit(0), "v", "p", "g").count() == 0


def test_z_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 4.0), (None, 8.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    got = sorted((str(r.g), r.v or 0, r.z) for r in K.z_by_group(df, {"z": "v"}, "g").collect())
    z = pytest.approx(0.5**0.5)
    assert got == [("None", 4.0, pytest.approx(-(0.5**0.5))), ("None", 8.0, z), ("a", 0, None), ("a", 1.0, pytest.approx(-(0.5**0.5))), ("a", 3.0, z), ("b", 2.0, None), ("b", 2.0, None)]
    assert "Window" not in K.z_by_group(df, {"z": "v"}, "g")._jdf.queryExecution().toString()


def test_varied(spark):
    df = spark.createDataFrame([(1.0, 1, None, float("nan")), (1.0, 2, None, 3.0)], "a double, b int, c int, d double")
    assert S.varied(df, ["a", "b", "c", "d"]) == ["b"] and S.varied(df.limit(0), ["a", "b"]) == [] == S.varied(df, [])


def test_pooled_rank_agrees(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.choice([None, *range(40)])) for i in range(500)], "id int, v int")
    got = K.pooled_rank(df, "v").toPandas()
    assert np.allclose(got["rank"].to_numpy(float), got.v.rank().to_numpy(), equal_nan=True)


def test_allocation(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "k string, n long")
    assert {r.k: r.n_primary for r in P.allocate(sizes, 11, "k").collect()} == {"a": 6, "b": 3, "c": 2}
    assert sum(r.n_primary for r in P.allocate(sizes, 1000, "k").collect()) == 100


def test_draw_does_not_depend_on_order(spark):
    rows = [(i, i % 3) for i in range(300)]
    one = P.stratified_draw(spark.createDataFrame(rows, "id int, s int"), "id", 30, 5, ["s"])
    two = P.stratified_draw(spark.createDataFrame(rows[::-1], "id int, s int").repartition(7), "id", 30, 5, ["s"])
    assert S.same_rows(one, two).first()[2:] == (0, 0)
    assert one.where("NOT is_replacement").count() == 30 and one.where("is_replacement").count() == 3


def test_promotion(spark):
    rows = [(0, False, False), (1, True, False), (2, False, True), (3, True, True), (4, True, True)]
    df = spark.createDataFrame([(r, ok, rep, "s") for r, ok, rep in rows], "stratum_rank int, ok boolean, is_replacement boolean, s string")
    assert [r.stratum_rank for r in P.promote(df, "ok", ["s"]).where("promoted").collect()] == [3]


def test_match(spark):
    papers = spark.createDataFrame([(1, 2000, "a b"), (2, 2000, "tied one"), (3, 2000, " ".join(f"w{i}" for i in range(20))), (4, 2000, "x")], "paper_id int, year int, norm string")
    works = spark.createDataFrame(
        [(10, 2001, "a b", 5), (11, 2000, "a b", 1), (12, 1999, "tied one", 3), (13, 2001, "tied one", 3), (14, 2000, " ".join(f"w{i}" for i in range(19)), 1), (15, 2005, "x", 1)],
        "work_id int, wyear int, wnorm string, cites int",
    )
    got = {r.paper_id: (r.work_id, r.match_method) for r in M.pick_match(papers, works).collect()}
    assert got == {1: (11, "exact"), 2: (None, "ambiguous"), 3: (14, "fuzzy"), 4: (None, "none")}


def test_copies_are_matched_once(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(22)]
    kinds = [" ".join(words), " ".join(words[::-1]), " ".join(words[1:]), " ".join(words[2:]), "the of", "of the", "the of the", "a b", ""]
    left = [(i, rng.choice([2000, 2001, 2003, None]), rng.choice(kinds)) for i in range(80)]
    few = [(i, 2000 + i, kinds[i % 4]) for i in range(4)]
    works = [(i, rng.choice([2000, 2001, 2003, 2005]), rng.choice(kinds[:-2]), rng.randint(0, 1)) for i in range(60)]
    seen, title_pairs = [], M.title_pairs

    def counted(a, b, least):
        seen.append((a.count(), b.count()))
        return title_pairs(a, b, least)

    monkeypatch.setattr(M, "title_pairs", counted)
    for right in (works, [(*w, None) for w in few], [(*w[:2], w[2] + " x", 1) for w in works[:9]]):
        want = {}
        for p, y, a in left:
            near = [w for w in right if y and abs(w[1] - y) <= 1]
            same = sorted((abs(w[1] - y), -(w[3] or 0), w[0]) for w in near if a and w[2] == a)
            share = lambda b: len({*a.split()} & {*b.split()}) / max(len({*a.split()} | {*b.split()}), 1)
            like = sorted((-share(w[2]), w[0]) for w in near if share(w[2]) >= 0.9)
            if same:
                want[p] = (None, "ambiguous") if len(same) > 1 and same[0][:2] == same[1][:2] else (same[0][2], "exact")
            elif like:
                want[p] = (like[0][1], "fuzzy") if len(like) < 2 or like[1][0] - like[0][0] >= 0.05 - 1e-12 else (None, "ambiguous")
            else:
                want[p] = (None, "none")
        one = spark.createDataFrame(left, "paper_id int, year int, norm string")
        two = spark.createDataFrame(right, "work_id int, wyear int, wnorm string, cites int")
        assert {r.paper_id: (r.work_id, r.match_method) for r in M.pick_match(one, two).collect()} == want
    assert all(a <= 18 and b <= 24 for a, b in seen)


@pytest.mark.parametrize("common", [10_000, 2])
def test_title_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(M, "COMMON", common)
    rng = random.Random(8)
    pool = ["the", "of"] * 6 + [f"w{i}" for i in range(30)]
    titles = [" ".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(60)]
    left = [(i, 2000 + i % 3, t) for i, t in enumerate(titles)] + [(900, 2000, ""), (901, None, "the of"), (902, 2000, None)]
    near = [" ".join(t.split()[1:] if i % 3 else [*t.split(), "more"]) for i, t in enumerate(titles)]
    right = [(i, 2000 + i % 4, t) for i, t in enumerate(near + titles[:20])] + [(500, 2000, ""), (501, None, "the of")]
    one = spark.createDataFrame(left, "paper_id int, year int, norm string")
    two = spark.createDataFrame(right, "work_id int, wyear int, wnorm string")
    for least in (0.5, 0.9):
        want = {}
        for p, y, a in left:
            for w, z, b in right:
                s, t = set((a or "").split()), set((b or "").split())
                if s and t and y and z and abs(y - z) <= 1 and len(s & t) / len(s | t) >= least:
                    want[p, w] = len(s & t) / len(s | t)
        got = {(r.paper_id, r.work_id): r.score for r in M.title_pairs(one, two, least).collect()}
        assert got == pytest.approx(want) and len(want) > 15


def test_spearman_and_p(spark):
    rng = random.Random(2)
    rows = [(float(i), i + rng.gauss(0, 20)) for i in range(60)]
    got = S.spearman(spark.createDataFrame(rows, "x double, y double").withColumn("k", F.lit(1)), "x", "y", ["k"]).first()
    x = pd.DataFrame(rows).rank()
    assert got.rho == pytest.approx(x[0].corr(x[1]))
    assert S.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15 + [(None, 1)], "a int, b int")
    assert S.cohens_kappa(df, "a", "b").first().kappa == pytest.approx(0.4)


def planted(spark, n=4000):
    rng = np.random.default_rng(3)
    year = rng.integers(0, 20, n)
    x = rng.normal(size=n) + year * 0.1
    y = 0.3 * x + rng.normal(size=20)[year] + rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"year": year, "x": x, "y": y})), (year, x, y)


def test_fixed_effects(spark):
    df, (year, x, y) = planted(spark)
    got = S.ols_fe_cluster(df, "y", ["x"], "year").iloc[0]
    dummies = np.column_stack([x, *(year == k for k in range(20))]).astype(float)
    beta, *_ = np.linalg.lstsq(dummies, y, rcond=None)
    assert got.coef == pytest.approx(beta[0]) and 0.2 < got.coef < 0.4 and got.p < 1e-6


def test_mixed_model(spark):
    df, _ = planted(spark)
    got = S.mixed_lm(df, "y", ["x"], "year").set_index("term")
    assert 0.25 < got.coef["x"] < 0.35 and 0.9 < got.resid_var["x"] < 1.1 and 0.3 < got.group_var["x"] < 2.5


def test_many_groups(spark):
    """Twenty thousand groups, three rows each: the driver gets a row for each ratio tried, not for each group."""
    rng = np.random.default_rng(9)
    g = np.repeat(np.arange(20_000), 3)
    x = rng.normal(size=len(g))
    y = 2 + 0.3 * x + rng.normal(size=20_000)[g] * 0.7 + rng.normal(size=len(g))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y}))
    got = S.mixed_lm(df, "y", ["x"], "g").set_index("term")
    # REML of balanced groups has a closed form for the variances: mean squares within and between groups.
    e = (y - got.coef["intercept"] - got.coef["x"] * x).reshape(-1, 3)
    within = ((e - e.mean(1, keepdims=True)) ** 2).sum() / (2 * 20_000)
    between = 3 * (e.mean(1) ** 2).sum() / 20_000
    assert got.resid_var["x"] == pytest.approx(within, rel=2e-3) and got.group_var["x"] == pytest.approx((between - within) / 3, rel=2e-2)
    assert got.coef["x"] == pytest.approx(0.3, abs=0.02) and got.n_groups["x"] == 20_000
    fe = S.ols_fe_cluster(df, "y", ["x"], "g").iloc[0]
    a, b = x.reshape(-1, 3), y.reshape(-1, 3)
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    coef = (a * b).sum() / (a * a).sum()
    u = (a * (b - coef * a)).sum(1)
    n, k = len(g), 20_001
    want = np.sqrt((u @ u) * (20_000 / 19_999) * ((n - 1) / (n - k))) / (a * a).sum()
    assert (fe.coef, fe.se) == (pytest.approx(coef), pytest.approx(want))


def test_mutual_information():
    from scriptorium.operators.topics import adjusted_mutual_information

    assert adjusted_mutual_information(np.diag([5, 5, 5])) == pytest.approx(1.0)
    assert abs(adjusted_mutual_information(np.full((3, 3), 20))) < 0.02


def test_topics_are_pure(spark):
    from scriptorium.operators.topics import topics

    rng = random.Random(4)
    words = [[f"{c}word{i}" for i in range(30)] for c in "abc"]
    rows = [(i, " ".join(rng.choices(words[i % 3], k=25))) for i in range(120)]
    found, terms = topics(spark.createDataFrame(rows, "paper_id int, text string"), 3, 1)
    x = found.toPandas()
    purity = x.groupby("topic").paper_id.apply(lambda p: (p % 3).value_counts().max()).sum() / 120
    assert purity >= 0.8 and terms.count() == 24


def test_topic_stability(spark):
    from scriptorium.operators.topics import embedded, stability, third

    rng = random.Random(6)
    words = [[f"{c}word{i}" for i in range(20)] for c in "abc"]
    rows = [(i, " ".join(rng.choices(words[i % 3], k=30))) for i in range(150)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "paper_id int, text string")
    low, cells, values = embedded(df, 20)
    assert low.count() == 152 and {len(r.low) for r in low.collect()} == {20} and cells.where("paper_id >= 900").count() == 0
    assert list(values) == sorted(values, reverse=True) and sum(values**2) <= 150
    got = stability(low, 3, 5).first()
    assert got.ari > 0.9 and got.ami > 0.9 and got.held_out_n == df.where(third("paper_id") == 2).count()


def test_proceedings_pages(spark):
    old = '<div class="container-fluid">x</div><div class="container-fluid"><ul><li><a href="/paper/1990/hash/abc-Abstract.html">t</a></li><li><a href="/other">o</a></li></ul>'
    new = '<ul class="paper-list"><li><a title="paper title" href="/paper/2021/hash/def-Abstract.html">t</a><a href="/x">y</a></li></ul>'
    page = '<meta name="citation_title" content=" T "><meta name="citation_author" content="Doe, Jane"><meta name="citation_author" content=""><p class="paper-abstract"><p>One <b>two</b> &amp; three</p></p>'
    df = spark.createDataFrame([(old, new, page)], "o string, n string, p string")
    got = df.select(html.index_hashes_old(F.col("o")), html.index_hashes_new(F.col("n")), html.citation_title(F.col("p")), html.citation_authors(F.col("p")), html.paper_abstract(F.col("p"))).first()
    assert tuple(got) == (["abc"], ["def"], "T", ["Jane Doe"], "One two & three")


def test_tei():
    xml = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><profileDesc><abstract><p>Abs  text</p></abstract></profileDesc></teiHeader>
    <text><body><div><head>1 Intro</head><p>See http://a.b/c.</p></div><div><p>untitled</p></div><figure><head>Figure 1</head><figDesc>A plot</figDesc></figure><ptr target="http://z"/></body></text></TEI>"""
    got = fulltext.parse_tei(xml)
    assert [s["heading"] for s in got["sections"]] == ["Abstract", "1 Intro", ""]
    assert got["figure_captions"] == ["Figure 1: A plot"] and got["urls"] == ["http://a.b/c", "http://z"]
    assert fulltext.parse_tei("<TEI>") is None and fulltext.parse_tei(None) is None


def test_line_sections(spark):
    lines = [("Abstract", 10.0), ("We do", 10.0), ("it.", 10.0), ("2 Big Heading", 14.0), ("Body http://x.y/z.", 10.0), ("Figure 1: cap", 10.0)]
    df = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(lines)], "id int, line_no int, text string, size double")
    got = fulltext.line_sections(df, "id").first()
    assert [(s.heading, s.text) for s in got.sections] == [("Abstract", "We do it."), ("2 Big Heading", "Body http://x.y/z.")]
    assert got.figure_captions == ["Figure 1: cap"] and got.urls == ["http://x.y/z"]


def test_incremental(spark, tmp_path):
    from scriptorium.streaming import incremental as I

    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id int, t string")
    path = str(tmp_path / "out")
    I.append_new(df.where("id < 4"), lambda x: x, path, ["id"])
    I.append_new(df, lambda x: x, path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))


def test_follow(spark, tmp_path):
    from scriptorium.streaming import incremental as I

    source, out, mark = (str(tmp_path / k) for k in ("in", "out", "mark"))
    spark.range(5).write.parquet(source)
    for n in (5, 8):
        I.follow(spark, source, "id long", lambda x: x, out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == n
        if n == 5:
            spark.range(3).write.mode("append").parquet(source)


def test_scores_reader(spark, tmp_path):
    (tmp_path / "judge_a.csv").write_text("paper_id,venue,year,prompt_name,run,score,raw_output\np1,v,2000,simple,1,4.0,x\np2,v,2000,simple,1,,y\np3,v,2000,simple,1,bad,z\n")
    got = tables.read_scores(spark, str(tmp_path)).collect()
    assert [(r.paper_id, r.score, r.model) for r in got] == [("p1", 4.0, "judge_a")]


def test_beta_limits():
    assert S.beta_inc(2, 3, 0) == 0 and S.beta_inc(2, 3, 1) == 1
    assert S.beta_inc(1, 1, 0.3) == pytest.approx(0.3)
    assert math.isclose(S.beta_inc(2, 2, 0.5), 0.5)
