"""Skip counts in one pass, tables found by key, and metrics that fail on some rows."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.metrics import Metric, apply
from scriptorium.sources import stages, tables

RAW = "year int, id string, source_id string, title string, abstract string, authors array<string>, tag string, tags array<string>"
ROWS = [
    (1990, "a", None, " T ", "one two three four five", ["x"], "", []),
    (1990, " ", "s", "T", "one two  three four five", ["x"], "k", ["v"]),
    (1990, "b", None, "  ", "short", [], None, None),
    (1990, "c", None, "T", "one two three  four ", ["x"], None, None),
    (1990, "d", None, "T", None, ["x"], None, None),
    (1990, "e", None, "T", "one two three four five", [], None, None),
    (1990, "f", None, None, None, None, None, None),
    (1990, "g", None, "T", "one two three four five", None, None, None),
]


def test_ingest_counts_in_one_pass(spark, tmp_path):
    touched = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(c):
        touched.add(1)
        return c

    raw = spark.createDataFrame(ROWS, RAW).repartition(3).withColumn("abstract", count.asNondeterministic()("abstract"))
    kept, seen = stages.ingest_counted(raw, "v", F.col("abstract"), F.col("authors"), {"tag": F.col("tag"), "tags": F.col("tags")})
    got = stages.written_with_report(kept, seen, f"{tmp_path}/out", f"{tmp_path}/report")
    assert got == {"n_read": 8, "n_kept": 2, "no_title": 2, "short_abstract": 2, "no_authors": 2} and touched.value == len(ROWS)
    assert spark.read.json(f"{tmp_path}/report").first().asDict() == got
    rows = {r.paper_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(rows) == {"1990_a", "1990_s"} and rows["1990_a"].title == "T"
    assert (rows["1990_a"].tag, rows["1990_a"].tags, rows["1990_s"].tag, rows["1990_s"].tags) == (None, None, "k", ["v"])


def test_ingest_of_nothing(spark, tmp_path):
    kept, seen = stages.ingest_counted(spark.createDataFrame([], RAW), "v", F.col("abstract"), F.col("authors"))
    assert set(stages.written_with_report(kept, seen, f"{tmp_path}/out", f"{tmp_path}/report").values()) == {0}


@pytest.fixture
def folders(spark, tmp_path):
    rows = [(f"{y}_{i}", v, y, i) for i, (v, y) in enumerate((v, y) for v in ("iclr", "icml") for y in range(2000, 2010))]
    path = f"{tmp_path}/papers"
    tables.write_partitioned(spark.createDataFrame(rows, "paper_id string, venue string, year int, n int"), path)
    return path


def plan(df):
    return df._jdf.queryExecution().toString()


def test_find_reads_the_years_of_keys(spark, folders):
    one = stages.find(spark, folders, "2003_13")
    assert [r.n for r in one.collect()] == [13] and "PartitionFilters: [isnotnull(year" in plan(one)
    assert stages.find(spark, folders, "none").count() == 0
    keys = spark.createDataFrame([("2003_13",), ("2003_3",), ("2009_9",), ("2009_9",), ("2001_99",), ("x_1",), (None,)], "paper_id string")
    got = stages.find_all(spark, folders, keys)
    assert sorted(r.n for r in got.collect()) == [3, 9, 13] and "PartitionFilters: [year#" in plan(got) and "IN (2001,2003,2009)" in plan(got)
    assert stages.read_venues(spark, folders, ["icml", "gone"]).count() == 10 and "PartitionFilters: [venue" in plan(stages.read_venues(spark, folders, ["icml", "gone"]))


def test_a_failing_row_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "12")], "id int, text string")
    metrics = [
        Metric("size", F.length),
        Metric("upper", F.upper),
        Metric("first", function=lambda t: t[0], kind="string"),
        Metric("number", function=float),
        Metric("parts", function=list, kind="array<string>"),
    ]
    out = apply(df, "text", metrics, ["id"])
    got = {r.id: r for r in out.collect()}
    assert (got[1]["size"], got[1].upper, got[1].first, got[1].number, got[1].parts) == (3, "ABC", "a", None, ["a", "b", "c"])
    assert [e.metric for e in got[1].errors] == ["number"] and [e.metric for e in got[2].errors] == ["first", "number"]
    assert got[2]["size"] == 0 and got[2].parts == [] and got[3].errors == [] and got[3].first is None and got[4].number == 12.0
    assert plan(out).count("ArrowEvalPython") <= 4 and plan(out).split("Physical Plan")[1].count("ArrowEvalPython") == 1
    assert apply(df, "text", metrics[:2], ["id"]).columns == ["id", "size", "upper", "errors"]
    with pytest.raises(ValueError):
        Metric("both", F.length, len)
    with pytest.raises(ValueError):
        apply(df, "text", metrics, ["size"])
