"""Incremental runs: append what is missing, or follow new files as a stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.matching import pending


def append_new(df: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, keys: list[str]) -> None:
    """Compute and append the rows whose keys the table at path lacks."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        compute(df).write.parquet(path)
        return
    compute(pending(df, done, keys)).write.mode("append").parquet(path)


def follow(spark: SparkSession, source: str, schema: str, compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A query that computes each new file once; a batch that is run again replaces its own folder."""
    files = spark.readStream.schema(schema).parquet(source)

    def put(batch: DataFrame, epoch: int) -> None:
        compute(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def top_up(
    spark: SparkSession,
    source: str,
    schema: str,
    compute: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    keys: tuple[str, ...] = ("year", "paper_id"),
    within: tuple[str, str] | None = None,
):
    """A query that computes each key once, in whatever file and run its row arrives, and counts what is done.

    ``path/rows`` has the computed rows and ``path/counts`` their number by the first key, a folder for each batch of both; a
    batch that is run again after a failure replaces its folders. Which keys are done is state of the stream in
    ``checkpoint``: for ever, or with ``within`` (a time column and a delay) until the watermark has passed them, after which
    rows that late are left out. Of rows with equal keys one is taken; a row with a null key is a key of its own by its
    content. ``compute`` keeps the first key's column."""
    rows = spark.readStream.schema(schema).parquet(source)
    none = reduce(or_, [F.col(k).isNull() for k in keys])
    rows = rows.withColumn("_whole", F.when(none, F.sha2(F.to_json(F.struct("*")), 256)))
    if within:
        rows = rows.withWatermark(*within).dropDuplicatesWithinWatermark([*keys, "_whole"])
    else:
        rows = rows.dropDuplicates([*keys, "_whole"])

    def put(batch: DataFrame, epoch: int) -> None:
        at = f"{path}/rows/batch={epoch}"
        done = compute(batch.drop("_whole"))
        done.write.mode("overwrite").parquet(at)
        counts = batch.sparkSession.read.schema(done.schema).parquet(at).groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={epoch}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, path: str, papers: DataFrame, key: str = "year") -> DataFrame:
    """key, n_papers, n_rows, complete: what ``top_up`` has done of the papers, from its counts alone; null is a key."""
    done = spark.read.parquet(f"{path}/counts").groupBy(F.col(key).alias("_key")).agg(F.sum("n").alias("n_rows"))
    want = papers.groupBy(key).agg(F.count(F.lit(1)).alias("n_papers"))
    both = want.join(done, F.col(key).eqNullSafe(F.col("_key")), "full")
    n, m = (F.coalesce(c, F.lit(0)) for c in ("n_papers", "n_rows"))
    return both.select(F.coalesce(key, "_key").alias(key), n.alias("n_papers"), m.alias("n_rows"), (m >= n).alias("complete"))


def windowed_counts(events: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Counts and means of a stream by time window and type; events later than ``late`` are left out."""
    at = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    got = at.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "mean")
