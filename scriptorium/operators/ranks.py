"""Ranks, percentiles, terciles, z-scores and rolling means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources.scratch import written


def average_rank(value: str, *keys: str) -> Column:
    """Rank within keys, ties at their mean; rows must have the value."""
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0


def _offsets(df: DataFrame, n: Column, keys: list[str]) -> DataFrame:
    """_p, keys, _before (sum of n in range partitions before _p) and _all (in all); a row for each partition and key in it."""
    parts = df.groupBy("_p", *keys).agg(F.sum(n).alias("_m"))
    w = Window.partitionBy(*keys)
    return parts.select("_p", *keys, (F.sum("_m").over(w.orderBy("_p")) - F.col("_m")).alias("_before"), F.sum("_m").over(w).alias("_all"))


def _with_keys(left: DataFrame, right: DataFrame, keys: list[str], on: list[str] = [], how: str = "inner") -> DataFrame:
    """Join by columns that are equal (on) and by columns that are equal or both null (keys)."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in [*keys, *on]})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys] + [F.col(c) == F.col(f"_right_{c}") for c in on]
    return left.join(right, same, how).drop(*[f"_right_{c}" for c in [*keys, *on]])


def _ranks(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, value, _rank and _all (values of the key): distinct values are counted, range-partitioned and offset."""
    by = [*keys, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "ranks")
    here = F.sum("_n").over(Window.partitionBy("_p", *keys).orderBy(value)) - F.col("_n")
    at = _with_keys(counts.withColumn("_here", here), _offsets(counts, F.col("_n"), keys), keys, ["_p"])
    return at.select(*by, (F.col("_before") + F.col("_here") + (F.col("_n") + 1) / 2.0).alias("_rank"), "_all")


def pooled_rank(df: DataFrame, value: str, out: str = "rank", keys: tuple[str, ...] = ()) -> DataFrame:
    """df with the average rank over all rows (of the same keys, nulls being one); no task sees all rows of a key.
    Null values have none."""
    ranks = _ranks(df, value, [*keys]).select(*keys, value, F.col("_rank").alias(out))
    return _with_keys(df, ranks, [*keys], [value], "left")


def percentiles(df: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """df with the average rank over the number of values of the same keys, nulls being one key, by range partitions;
    null values get none and count in none."""
    ranks = _ranks(df, value, [*keys]).select(*keys, value, (F.col("_rank") / F.col("_all")).alias(out))
    return _with_keys(df, ranks, [*keys], [value], "left")


def z_by_group(df: DataFrame, values: dict[str, str], *keys: str) -> DataFrame:
    """df with a z-score (name: column) within keys, nulls being one key: moments by aggregate, joined back, so a large group
    is never one task's. Groups without deviation have null."""
    moments = [f(c).alias(f"_{n}_{out}") for out, c in values.items() for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    at = _with_keys(df, df.groupBy(*keys).agg(*moments), [*keys])
    z = {out: (F.col(c) - F.col(f"_mean_{out}")) / F.nullif(F.col(f"_std_{out}"), F.lit(0.0)) for out, c in values.items()}
    return at.withColumns(z).drop(*[f"_{n}_{out}" for out in values for n in ("mean", "std")])


def ranked(df: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """df with rank (from 1, by the columns of order, within non-null keys) and n (rows of the key), by range partitions."""
    at = written(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "ranked")
    here = F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order))
    at = at.withColumn("_here", here).join(_offsets(at, F.lit(1), keys), ["_p", *keys])
    return at.withColumns({"rank": F.col("_before") + F.col("_here"), "n": F.col("_all")}).select(*df.columns, "rank", "n")


def terciles(df: DataFrame, value: str, key: str, band: str) -> DataFrame:
    """df with tercile: 0, 1 or 2 by quantile cuts of first-come ranks, ties by key; a band of fewer than 3 rows is all 1."""
    at, r, n = ranked(df, [value, key], [band]), F.col("rank"), F.col("n")
    cut = F.when(n < 3, 1).when(3 * r < n + 2, 0).when(3 * r < 2 * n + 1, 1).otherwise(2)
    return at.select(*df.columns, cut.alias("tercile"))


def baseline_z(value: str, when: Column, *keys: str, least: int = 3) -> Column:
    """z-score against the rows of the key for which ``when`` holds; null with fewer than ``least`` of them."""
    w = Window.partitionBy(*keys)
    base = F.when(when, F.col(value))
    z = (F.col(value) - F.avg(base).over(w)) / F.nullif(F.stddev_samp(base).over(w), F.lit(0.0))
    return F.when(F.count(base).over(w) >= least, z)


def rolling_mean(value: str, order: str, *keys: str, half: int = 1) -> Column:
    """Centred mean over neighbouring rows."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))


def year_band(year: Column, bands) -> Column:
    out = F.lit("out_of_range")
    for a, b in bands:
        out = F.when(year.between(a, b), f"{a}-{b}").otherwise(out)
    return out
