"""Readers and writers of papers, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "year int, id string, title string, abstract string, full_text string, authors array<string>, source_id string"
PROCESSED = (
    "paper_id string, venue string, year int, title string, abstract string, authors array<string>, "
    "arxiv_categories array<string>, arxiv_primary_category string"
)
SCORES = "paper_id string, venue string, year int, prompt_name string, run int, score string, raw_output string"
JUDGMENTS = "paper_id string, feature string, run int, raw_output string"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of records, a file a year."""
    return spark.read.schema(RAW).json(path, multiLine=True)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROCESSED).json(path, multiLine=True)


def write_partitioned(df: DataFrame, path: str) -> None:
    """Idempotent: only partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("venue", "year").parquet(path)


def ingest(raw: DataFrame, venue: str, abstract, authors) -> DataFrame:
    """Records with a title, an abstract of 5 words and an author; ids are year and hash."""
    at = raw.withColumns({"abstract": abstract, "authors": authors})
    words = F.size(F.split(F.trim("abstract"), r"\s+"))
    ok = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.col("abstract") != "") & (words >= 5) & (F.size("authors") > 0)
    key = F.concat_ws("_", F.col("year").cast("string"), F.coalesce("id", "source_id"))
    return at.where(ok).select(key.alias("paper_id"), F.lit(venue).alias("venue"), "year", "title", "abstract", "authors")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Judge scores; rows whose score is no number are dropped; the model is the file's name."""
    got = spark.read.schema(SCORES).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    model = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return got.withColumns({"score": F.col("score").try_cast("double"), "model": model}).where("score IS NOT NULL")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(JUDGMENTS).json(path).where("paper_id IS NOT NULL")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return lines.where("word <> '' AND NOT startswith(word, '#')").distinct()


def read_binary(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files that are PDF by their first bytes."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return got.where(F.substring("content", 1, 4) == F.lit(b"%PDF"))


def write_plot_csv(df: DataFrame, path: str) -> None:
    """One sorted file with ``nan`` for what is missing; for yearly aggregates."""
    df.orderBy(df.columns[0]).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "nan").csv(path)


def write_sorted(df: DataFrame, key: str, path: str) -> None:
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_fan_out(df: DataFrame, key: str, outputs: dict[str, list[str]], path: str) -> None:
    """One computation, several tables of its columns."""
    held = df.persist()
    try:
        for name, cols in outputs.items():
            held.select(key, *cols).write.mode("overwrite").parquet(f"{path}/{name}")
    finally:
        held.unpersist()


def explain(df: DataFrame, key: str, value, columns: list[str]) -> DataFrame:
    """One paper's features as JSON."""
    return df.where(F.col(key) == value).select(F.to_json(F.struct(*columns)).alias("json"))


def require(path_exists: bool, what: str) -> None:
    if not path_exists:
        raise FileNotFoundError(f"{what} is required before this stage can run")
