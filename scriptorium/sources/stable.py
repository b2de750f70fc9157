"""Files whose bytes depend on the rows alone: not on partitions, tasks or their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StructType, VariantType

from scriptorium.sources.scratch import written


def _ordered(t: DataType) -> bool:
    if isinstance(t, StructType):
        return all(_ordered(f.dataType) for f in t.fields)
    return _ordered(t.elementType) if t.typeName() == "array" else not isinstance(t, (MapType, VariantType))


#: Files of a task, on average, at most.
FILES = 32
#: With these a column has one encoding. Of several, the footer's list stands in the order of a hash set that each JVM has
#: its own way, so files of two executors would differ.
ONE_ENCODING = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def in_files(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Distinct rows of df with _file (from 0) and _copies there: file k holds the rows k * rows to (k + 1) * rows in order.

    The order is that of the named columns, then of all others, so only equal rows tie. Those are counted before the shuffle
    and dealt over the files that they reach into; a row's place is the number of rows before it, from counts by range
    partition. Nulls come first; -0.0 is written as 0.0. Maps have no order: ValueError."""
    return _placed(df, order, rows)[0]


def _placed(df: DataFrame, order: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """in_files, and its table of distinct rows with their number, _n."""
    without = [f.name for f in df.schema.fields if not _ordered(f.dataType)]
    if without:
        raise ValueError(f"columns without an order: {', '.join(without)}")
    by = [*order, *[c for c in df.columns if c not in order]]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "counted-rows")
    parts = counts.groupBy("_p").agg(F.sum("_n").alias("_m"))
    before = parts.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_before"))  # a row for each partition
    here = F.sum("_n").over(Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    at = counts.withColumn("_here", F.coalesce(here, F.lit(0))).join(before, "_p")
    first = F.col("_before") + F.col("_here")
    at = at.withColumns({"_first": first, "_end": first + F.col("_n")})
    at = at.withColumn("_file", F.explode(F.sequence(F.expr(f"_first div {rows}"), F.expr(f"(_end - 1) div {rows}"))))
    copies = F.least("_end", (F.col("_file") + 1) * rows) - F.greatest("_first", F.col("_file") * rows)
    return at.select(*df.columns, "_file", copies.alias("_copies")), counts


def write_stable(df: DataFrame, order: list[str], path: str, rows: int = 1_000_000) -> None:
    """A sorted table in folders file=0, file=1, ..., of ``rows`` rows each, the last one less.

    The same rows give the same bytes in each folder, whichever executor writes it (the names of Parquet files differ). A file is one task's, sorted with
    spilling; column names that begin with _ and the name ``file`` are taken. An empty table gives no file."""
    at, counts = _placed(df, order, rows)
    files = -(-(counts.agg(F.sum("_n")).first()[0] or 0) // rows)
    tasks = max(1, min(files, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-files // FILES))))
    by = [*order, *[c for c in df.columns if c not in order]]
    # Distinct rows are dealt, by a number that Spark does not lower for their few bytes, and copied where they are written.
    at = at.repartition(tasks, "_file").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    at = at.sortWithinPartitions("_file", *by)
    at.select(*df.columns, F.col("_file").alias("file")).write.options(**ONE_ENCODING).mode("overwrite").partitionBy("file").parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, n_bytes, sha256 of a table that write_stable has written; a file is read whole, so its rows bound the memory."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    file = F.regexp_extract("path", r"/file=(\d+)/[^/]*$", 1).try_cast("long")
    return got.select(file.alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, and why two tables of digests differ there: missing (in b), extra, or bytes; no rows if they agree."""
    both = a.select("file", F.col("sha256").alias("_a")).join(b.select("file", F.col("sha256").alias("_b")), "file", "full")
    why = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "bytes")
    return both.select("file", why.alias("why")).where("why IS NOT NULL")
