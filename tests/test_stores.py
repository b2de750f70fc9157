"""Byte-stable files, streams that top up, label sheets."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import labels as H
from scriptorium.operators import stats as S
from scriptorium.sources import html, stable
from scriptorium.streaming import incremental as I


def rows(spark):
    hot = [(None, "hot", 1.0, [1])] * 40
    return spark.createDataFrame(hot + [(i % 7, f"t{i}", i / 3, [i, None]) for i in range(60)] + [(3, None, None, None)] * 3, "k int, t string, v double, a array<int>")


def test_same_bytes_from_any_partitions(spark, tmp_path):
    df = rows(spark)
    a, b, c = (str(tmp_path / x) for x in "abc")
    stable.write_stable(df, ["k"], a, 25)
    stable.write_stable(df.repartition(7, "t").orderBy(F.desc("v")), ["k"], b, 25)
    one, two = stable.digests(spark, a), stable.digests(spark, b)
    assert [r.file for r in one.orderBy("file").collect()] == [0, 1, 2, 3, 4] and stable.changed_files(one, two).count() == 0
    back = spark.read.parquet(a)
    assert back.drop("file").exceptAll(df).count() == 0 and back.count() == df.count() == 103
    assert [r["count"] for r in back.groupBy("file").count().orderBy("file").collect()] == [25, 25, 25, 25, 3]
    want = df.orderBy("k", "t", "v", "a").collect()
    for k in range(5):
        assert spark.read.parquet(f"{a}/file={k}").collect() == want[25 * k : 25 * k + 25]
    stable.write_stable(df.where("t <> 't5' OR t IS NULL").unionByName(df.where("t = 't5'").withColumn("v", F.lit(9.0))), ["k"], c, 25)
    got = {r.file: r.why for r in stable.changed_files(one, stable.digests(spark, c)).collect()}
    assert got and set(got.values()) == {"bytes"} and 0 not in got
    fewer = stable.changed_files(one, two.where("file < 4"))
    assert [tuple(r) for r in fewer.collect()] == [(4, "missing")]


def test_stable_edges(spark, tmp_path):
    at = str(tmp_path / "none")
    stable.write_stable(rows(spark).limit(0), ["k"], at)
    assert stable.digests(spark, at).count() == 0
    with pytest.raises(ValueError, match="m, s"):
        stable.in_files(spark.sql("SELECT 1 AS k, map('a', 1) AS m, named_struct('x', array(map('a', 1))) AS s"), ["k"], 10)


def test_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    df = spark.range(0, 4000, 1, 3).selectExpr("id % 3 AS k", "'x' AS t")
    tasks = {}
    for most in (32, 4):
        monkeypatch.setattr(stable, "FILES", most)
        at = str(tmp_path / str(most))
        stable.write_stable(df, ["k"], at, 100)
        names = [r.f for r in spark.read.parquet(at).select(F.input_file_name().alias("f")).distinct().collect()]
        assert len(names) == 40
        tasks[most] = len({n.rsplit("/", 1)[1].split("-")[1] for n in names})
    assert tasks[32] > 1 and tasks[4] > 4 and stable.changed_files(*(stable.digests(spark, str(tmp_path / str(m))) for m in tasks)).count() == 0


def test_footers_do_not_depend_on_the_jvm(spark, tmp_path):
    at = str(tmp_path / "x")
    df = rows(spark).withColumns({"f": F.lit(0.5).cast("float"), "o": F.col("k") > 3, "d": F.lit("2024-01-01").cast("date"), "ts": F.lit(0).cast("timestamp"), "m": F.col("v").cast("decimal(30,2)"), "x": F.struct("t", "a"), "y": F.col("t").cast("binary")})
    stable.write_stable(df, ["k"], at, 25)
    files = list((tmp_path / "x").rglob("*.parquet"))
    for meta in (pq.ParquetFile(f).metadata for f in files):
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
        # Of two encodings, the footer's order would be that of a hash set by addresses.
        assert {len(g.column(c).encodings) for g in groups for c in range(g.num_columns)} == {1}
    assert len(files) == 5 and spark.read.parquet(at).drop("file").exceptAll(df).count() == 0


SCHEMA = "year int, paper_id long, text string, at timestamp"


def test_top_up_after_restart(spark, tmp_path):
    source, path, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.select("year", "paper_id", F.length("text").alias("n"))

    def run(batch):
        spark.createDataFrame([(*r, None) for r in batch], SCHEMA).write.mode("append").parquet(source)
        I.top_up(spark, source, SCHEMA, compute, path, mark).awaitTermination()

    papers = spark.createDataFrame([(2000, 1), (2000, 2), (2001, 3), (2001, 4), (None, 5), (2002, 6)], "year int, paper_id long")
    run([(2000, 1, "a"), (2001, 3, "b"), (2001, 3, "b"), (None, 5, "c")])
    state = lambda: {r.year: (r.n_papers, r.n_rows, r.complete) for r in I.progress(spark, path, papers).collect()}
    assert state() == {2000: (2, 1, False), 2001: (2, 1, False), None: (1, 1, True), 2002: (1, 0, False)}
    run([(2000, 1, "a"), (2000, 2, "late"), (2003, 9, "x"), (2003, None, "y"), (2003, None, "z")])
    assert state() == {2000: (2, 2, True), 2001: (2, 1, False), None: (1, 1, True), 2002: (1, 0, False), 2003: (0, 3, True)}
    I.top_up(spark, source, SCHEMA, compute, path, mark).awaitTermination()
    done = spark.read.parquet(f"{path}/rows").select("year", "paper_id", "n").collect()
    assert len(done) == 7 and len({(r.year, r.paper_id) for r in done}) == 6 and sum(seen) == 7


def test_top_up_runs_a_failed_batch_again(spark, tmp_path):
    source, path, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(2000, i, "a", None) for i in range(5)], SCHEMA).write.parquet(source)
    keep = lambda df: df.select("year", "paper_id")

    def fails(df):
        keep(df).write.mode("overwrite").parquet(f"{path}/rows/batch=0")
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        I.top_up(spark, source, SCHEMA, fails, path, mark).awaitTermination()
    I.top_up(spark, source, SCHEMA, keep, path, mark).awaitTermination()
    papers = spark.createDataFrame([(2000, i) for i in range(5)], "year int, paper_id long")
    assert [tuple(r) for r in I.progress(spark, path, papers).collect()] == [(2000, 5, 5, True)]
    assert spark.read.parquet(f"{path}/rows").count() == 5


def test_top_up_forgets_behind_the_watermark(spark, tmp_path):
    source, path, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for day, ids in (("01", [1, 1, 2]), ("02", [2, 3]), ("20", [4]), ("21", [4, 5])):
        df = spark.createDataFrame([(2000, i, "a") for i in ids], "year int, paper_id long, text string")
        df.withColumn("at", F.lit(f"2024-01-{day}").cast("timestamp")).write.mode("append").parquet(source)
        run = I.top_up(spark, source, SCHEMA, lambda d: d.select("year", "paper_id"), path, mark, within=("at", "3 days"))
        run.awaitTermination()
    assert sorted(r.paper_id for r in spark.read.parquet(f"{path}/rows").collect()) == [1, 2, 3, 4, 5]


def test_bounded_labels(spark):
    sheet = spark.createDataFrame([("p1", "3", "0"), ("p2", " 2.9 ", "7"), ("p3", "", "x"), ("p4", None, "nan"), (None, "Infinity", "-0.5")], "paper_id string, a string, b string")
    got = {(r.paper_id, r.prompt): (r.value, r.error) for r in H.bounded_labels(sheet, {"a": (1, 5), "b": (0, 4)}).collect()}
    assert got == {
        ("p1", "a"): (3, None),
        ("p1", "b"): (0, None),
        ("p2", "a"): (2, None),
        ("p2", "b"): (None, "outside [0,4]"),
        ("p3", "a"): (None, "empty"),
        ("p3", "b"): (None, "not an integer"),
        ("p4", "a"): (None, "empty"),
        ("p4", "b"): (None, "not an integer"),
        (None, "a"): (None, "not an integer"),
        (None, "b"): (0, None),
    }
    bad = H.bounded_labels(sheet, {"a": (1, 5), "b": (0, 4)})
    with pytest.raises(ValueError, match=r"(?s)None: a not an integer.*p2: b outside \[0,4\].*and 3 more"):
        H.checked(bad, 3)
    fine = H.bounded_labels(sheet.where("paper_id = 'p1'"), {"b": (0, 4), "a": (1, 5)})
    assert [tuple(r) for r in H.checked(fine).collect()] == [("p1", "a", 3), ("p1", "b", 0)]
    assert H.checked(bad.limit(0)).count() == 0


def test_abstract_links(spark):
    page = """<a href="/paper/2021/hash/ab1-Abstract.html"><a class='b' HREF = '/2021/hash/9f-Abstract-Round2.html?x=1&amp;y=2'>
      <a data-href="/2021/hash/aa-Abstract"><link href="/2021/hash/bb-Abstract"><a href="/2020/hash/cc-Abstract"><a title="> href" href="/2021/zz-Abstract">"""
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(html.abstract_links(F.col("h"), F.lit(2021)).alias("l"))
    rows = [r.l for r in df.collect()]
    assert rows == [["/paper/2021/hash/ab1-Abstract.html", "/2021/hash/9f-Abstract-Round2.html?x=1&y=2", "/2021/zz-Abstract"], [], []]
    assert [r.k for r in df.select(F.transform("l", lambda x: html.link_key(x)).alias("k")).collect()] == [["ab1", "9f", None], [], []]


def test_wide_summary(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "b", 4.0), (1, "a", None), (2, "a", 1.0), (3, None, 1.0)], "year int, model string, score double")
    got = S.wide_summary(df, "year", "model", "score")
    assert got.columns == ["year", "a_mean", "a_std", "a_count", "b_mean", "b_std", "b_count"]
    assert sorted(map(tuple, got.collect())) == [(1, None, None, 0, 3.0, 1.4142, 2), (2, 1.0, None, 1, None, None, 0), (3, None, None, 0, None, None, 0)]
    assert S.wide_summary(df.limit(0), "year", "model", "score").count() == 0
