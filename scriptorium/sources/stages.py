"""Stages that count what they skip in the pass that computes it, and tables that are found by their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REASONS = ("no_title", "short_abstract", "no_authors")


def skip_reason(title: Column, abstract: Column, authors: Column, least: int = 5) -> Column:
    """Why a record is skipped, the first reason of REASONS, or null."""
    words = F.size(F.filter(F.split(F.coalesce(abstract, F.lit("")), r"\s+"), lambda w: w != ""))
    why = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", REASONS[0]).when(words < least, REASONS[1])
    return why.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, REASONS[2])


def observed(df: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """df, and what its next action counts on the way: each value is an aggregate."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen


def ingest_counted(raw: DataFrame, venue: str, abstract: Column, authors: Column, extras: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """Kept records and an observation of n_read, n_kept and a count for each reason.

    Kept are paper_id (year and identifier), venue, year, title, abstract, authors and the ``extras``, which are null where
    they hold nothing, so that writers leave them out."""
    at = raw.select("*", abstract.alias("_abstract"), authors.alias("_authors"))
    at = at.withColumn("_why", skip_reason(F.col("title"), F.col("_abstract"), F.col("_authors")))
    counts = {"n_read": F.count(F.lit(1)), "n_kept": F.count_if(F.col("_why").isNull())}
    at, seen = observed(at, f"ingest {venue}", counts | {r: F.count_if(F.col("_why").eqNullSafe(F.lit(r))) for r in REASONS})
    key = F.concat_ws("_", F.col("year").cast("string"), F.coalesce(F.nullif(F.trim("id"), F.lit("")), "source_id"))
    more = [_filled(c).alias(k) for k, c in (extras or {}).items()]
    kept = at.where("_why IS NULL").select(key.alias("paper_id"), F.lit(venue).alias("venue"), "year", F.trim("title").alias("title"), F.col("_abstract").alias("abstract"), F.col("_authors").alias("authors"), *more)
    return kept, seen


def _filled(c: Column) -> Column:
    """Null for an empty string or array."""
    return F.when(F.to_json(F.struct(c.alias("v"))).rlike(r'^\{("v":("\s*"|\[\]|null))?\}$'), F.lit(None)).otherwise(c)


def written_with_report(df: DataFrame, seen: Observation, path: str, report: str) -> dict:
    """Writes df, then its counts as a JSON line; one pass over the data."""
    df.write.mode("overwrite").parquet(path)
    counts = dict(seen.get)
    spark = df.sparkSession
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in counts.items()])
    row.coalesce(1).write.mode("overwrite").json(report)
    return counts


def read_venues(spark: SparkSession, path: str, venues: list[str]) -> DataFrame:
    """Papers of some venues of a table partitioned by venue and year; a venue without papers gives none."""
    return spark.read.parquet(path).where(F.col("venue").isin(venues))


def year_of(key: Column) -> Column:
    """The year, of four digits at most, that a paper's key begins with; null if it begins with none."""
    return F.nullif(F.regexp_extract(key, r"^(\d{1,4})_", 1), F.lit("")).cast("int")


def find(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One paper: only the folders of the year in its key are read, or all if the key names none."""
    at, year = spark.read.parquet(path).where(F.col("paper_id") == key), key.split("_", 1)[0]
    return at.where(F.col("year") == int(year)) if year.isdecimal() else at


def find_all(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The papers of a table of keys (paper_id). The years in the keys, 10,000 at most, become a filter on folders, so those
    of other years are not read; keys that name no year are looked for in none."""
    keys = keys.select("paper_id", year_of(F.col("paper_id")).alias("year")).where("year IS NOT NULL").distinct()
    years = sorted(r.year for r in keys.select("year").distinct().collect())
    return spark.read.parquet(path).where(F.col("year").isin(years)).join(keys, ["year", "paper_id"])
