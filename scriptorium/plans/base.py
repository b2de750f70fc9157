"""How queries are registered, and what their SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its DuckDB SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers: paper_id, venue, year, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("paper_id"), F.col("source").alias("venue"), (1987 + F.col("doc_id") % 39).cast("int").alias("year"), "text")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as judges' scores: paper_id, model, prompt, run, year, score."""
    e = table(spark, sf_dir, "events")
    prompt = F.get_json_object("props", "$.k").cast("int") % 3
    return e.select(
        F.col("user_id").alias("paper_id"),
        F.col("event_type").alias("model"),
        prompt.alias("prompt"),
        (F.col("event_id") % 3).alias("run"),
        F.dayofmonth("ts").alias("year"),
        F.col("value").alias("score"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with customers as outcomes: paper_id, year, citations, subfield."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    got = o.join(c, o.o_custkey == c.c_custkey, "left")
    return got.select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("citations"), F.col("c_mktsegment").alias("subfield"))


PAPERS = "SELECT doc_id AS paper_id, source AS venue, (1987 + doc_id % 39)::INT AS year, text FROM documents"
SCORES = """SELECT user_id AS paper_id, event_type AS model, (json_extract_string(props, '$.k')::INT % 3) AS prompt,
  event_id % 3 AS run, day(ts)::INT AS year, value AS score FROM events"""
OUTCOMES = """SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year, o_totalprice AS citations,
  c_mktsegment AS subfield FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def text_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plain_letters(column: str) -> str:
    """SQL: letters and digits beyond ASCII as z, other signs beyond it as a stop, so that ASCII word ends suffice."""
    return rf"regexp_replace(regexp_replace({column}, '[^\x00-\x7F\p{{L}}\p{{N}}]', '.', 'g'), '[^\x00-\x7F]', 'z', 'g')"


def count_sql(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {text_sql(pattern)}))"
