"""Deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.ranks import ranked


def seeded(key: str, seed: int) -> Column:
    """A key's place in a draw: a digest that any engine can make."""
    return F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))))


def allocate(sizes: DataFrame, target: int, *keys: str) -> DataFrame:
    """Largest-remainder allocation of target among strata (keys, n), none above its size; ties by key."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # strata are few
    at = sizes.withColumns({"total": total, "exact": F.col("n") * target / total})
    at = at.withColumn("base", F.least(F.floor("exact"), F.col("n")))
    short = target - F.sum("base").over(Window.partitionBy(F.lit(1)))
    order = Window.partitionBy(F.lit(1)).orderBy((F.col("base") >= F.col("n")).cast("int"), F.desc(F.round(F.col("exact") - F.col("base"), 9)), *keys)
    more = ((F.row_number().over(order) <= short) & (F.col("base") < F.col("n"))).cast("long")
    n = F.when(F.col("total") <= target, F.col("n")).otherwise(F.col("base") + more)
    return at.select(*keys, "n", n.cast("long").alias("n_primary"))


def stratified_draw(df: DataFrame, key: str, target: int, seed: int, strata: list[str], overdraw: float = 0.1) -> DataFrame:
    """Primary rows of each stratum and ordered replacements, by seeded hash of the key; order of input is no matter."""
    plan = allocate(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")), target, *strata)
    at = ranked(df.withColumn("_drawn", seeded(key, seed)), ["_drawn", key], strata).drop("_drawn", "n")
    at = at.withColumn("stratum_rank", F.col("rank") - 1).drop("rank").join(F.broadcast(plan), strata)  # strata are few
    extra = F.least(F.col("n") - F.col("n_primary"), F.ceil(F.col("n_primary") * overdraw))
    at = at.where(F.col("stratum_rank") < F.col("n_primary") + extra)
    return at.withColumn("is_replacement", F.col("stratum_rank") >= F.col("n_primary")).drop("n", "n_primary")


def promote(sample: DataFrame, ok: str, strata: list[str]) -> DataFrame:
    """Marks replacements that stand in for failed primary rows, in rank order, as many as failed."""
    failed = F.sum(F.when(~F.col("is_replacement") & ~F.col(ok), 1).otherwise(0)).over(Window.partitionBy(*strata))
    order = Window.partitionBy(*strata).orderBy("stratum_rank").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.when(F.col("is_replacement") & F.col(ok), 1).otherwise(0)).over(order)
    return sample.withColumn("promoted", F.col("is_replacement") & F.col(ok) & (upto <= failed))


def seeded_draw(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(seeded(key, seed), key).limit(n)


def top_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.groupBy(column).count().orderBy(F.desc("count"), column).limit(n)


def bucket_other(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """Values beyond the n most frequent as ``other``."""
    top = F.broadcast(top_n(df, column, n).select(F.col(column), F.col(column).alias(out)))
    return df.join(top, column, "left").withColumn(out, F.coalesce(out, F.lit("other")))
