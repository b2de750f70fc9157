"""Flattening of nested works."""

from pyspark.sql import functions as F

from scriptorium.sources import works


def test_work_rows(spark):
    rows = [
        ("https://x/W1", "t", 2020, 30, {"doi": "d", "arxiv": "https://arxiv.org/abs/1901.00001"}, [("a",), ("b",)], [("A", 0.5), ("B", 0.9), ("C", 0.9)], [], "2019-05-01", None),
        ("W2", "t", 2020, 10, {}, None, None, [(("arXiv",), None, "https://arxiv.org/pdf/1902.00002v1")], "bad", None),
        ("W3", "t", 2030, None, None, [], [], [((None,), "http://other/abs/1903.00003", None)], None, None),
    ]
    got = works.finalize(works.work_rows(spark.createDataFrame(rows, works.WORK)))
    got = {r.work_id: r for r in got.collect()}
    assert (got["W1"].subfield, got["W1"].arxiv_id, got["W1"].author_count, got["W1"].preprint_before_conference) == ("B", "1901.00001", 2, True)
    assert (got["W2"].arxiv_id, got["W2"].author_count, got["W2"].preprint_before_conference) == ("1902.00002", 0, None)
    assert got["W3"].arxiv_id is None and got["W3"].cites_per_year is None and got["W1"].cites_per_year == 5.0


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("c",)], "k string")
    assert [tuple(r) for r in df.select(*works.one_hot("k", ["c", "a", "b"]).values()).collect()] == [(0.0, 0.0), (0.0, 1.0)]


def test_match_report(spark):
    df = spark.createDataFrame([(2000, 1), (2000, None)], "year int, work_id int")
    assert tuple(works.match_report(df, "year").first()) == (2000, 2, 1, 1)
    assert works.match_report(df.where(F.lit(False)), "year").count() == 0
