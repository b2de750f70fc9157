"""Rank correlations, agreement, and regressions over aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.operators.ranks import average_rank, pooled_rank
from scriptorium.sources.scratch import written


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for n in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + n * d
            c = 1 + n / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    def one(r, k):
        if pd.isna(r) or k < 3:
            return None
        return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((k - 2) / (1 - r * r)), k - 2)

    return pd.Series([one(r, k) for r, k in zip(rho, n)], dtype="float64")


def spearman(df: DataFrame, x: str, y: str, keys: list[str], n_min: int = 10, large: bool = False) -> DataFrame:
    """keys, n, rho of complete pairs within keys; null under n_min pairs or with a constant side.

    Ranks are windows over a key's rows; if those are too many for a task (``large``), they are counted by range."""
    at = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if large:
        at = written(at.select(*keys, x, y), "pairs")
        at = pooled_rank(pooled_rank(at, x, "_x", tuple(keys)), y, "_y", tuple(keys))
    else:
        at = at.withColumns({"_x": average_rank(x, *keys), "_y": average_rank(y, *keys)})
    agg = at.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("_x", "_y").alias("rho"),
        (F.min("_x") < F.max("_x")).alias("_a"),
        (F.min("_y") < F.max("_y")).alias("_b"),
    )
    ok = (F.col("n") >= n_min) & F.col("_a") & F.col("_b")
    return agg.select(*keys, "n", F.when(ok, F.col("rho")).alias("rho"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa over complete pairs; kappa is null if chance agreement is whole."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).count()
    rows = cells.groupBy("a").agg(F.sum("count").alias("r")).withColumnRenamed("a", "k")
    cols = cells.groupBy("b").agg(F.sum("count").alias("c")).withColumnRenamed("b", "k")
    chance = rows.join(cols, "k").agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    total = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0)).alias("same"))
    at = total.join(F.broadcast(chance))  # one row each
    po, pe = F.try_divide(F.col("same") * 1.0, F.col("n")), F.try_divide(F.col("rc") * 1.0, F.col("n") * F.col("n"))
    return at.select("n", po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def weak_p(p: Column) -> Column:
    return (p > 0.005) & (p < 0.05)


def group_moments(df: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Per group: n, sums (s_i) and cross products (q_i_j, j at most i) of the columns; a table, as groups have no bound."""
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)]
    cross = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    return written(df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *sums, *cross), "moments")


def _square(row, name: str, k: int) -> np.ndarray:
    """A symmetric matrix from a row's columns name_i_j."""
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            out[i, j] = out[j, i] = row[f"{name}_{i}_{j}"] or 0.0
    return out


def _lower(k: int, name: str, cell) -> list[Column]:
    return [F.sum(cell(i, j)).alias(f"{name}_{i}_{j}") for i in range(k) for j in range(i + 1)]


def _within(i: int, j: int) -> Column:
    """Cross product of two columns about the group's means."""
    a, b = max(i, j), min(i, j)
    return F.col(f"q_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")


def ols_fe_cluster(df: DataFrame, y: str, xs: list[str], group: str) -> pd.DataFrame:
    """OLS with fixed effects of the group absorbed and errors clustered by it. Two aggregates over the groups' moments: cross
    products within groups, then, with the coefficients, those of the groups' scores; the driver gets one row of each."""
    names, p = [y, *xs], len(xs)
    at = group_moments(df.dropna(subset=[*names, group]), group, names)
    one = at.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("obs"), *_lower(p + 1, "w", _within)).first()
    total = _square(one, "w", p + 1)
    bread = np.linalg.inv(total[1:, 1:])
    coef = bread @ total[1:, 0]
    # Sum of x * e of each group, for each x.
    score = [_within(i, 0) - sum(F.lit(float(c)) * _within(i, j + 1) for j, c in enumerate(coef)) for i in range(1, p + 1)]
    scores = at.select(*[c.alias(f"u_{i}") for i, c in enumerate(score)])
    meat = _square(scores.agg(*_lower(p, "m", lambda i, j: F.col(f"u_{i}") * F.col(f"u_{j}"))).first(), "m", p)
    g, obs, k = one.g, one.obs, p + one.g
    meat = meat * (g / (g - 1)) * ((obs - 1) / (obs - k))
    se = np.sqrt(np.diag(bread @ meat @ bread))
    values = [t_two_sided(b / e, g - 1) for b, e in zip(coef, se)]
    return pd.DataFrame({"term": xs, "coef": coef, "se": se, "p": values, "n_obs": int(obs), "n_groups": g})


#: Ratios that one pass over the groups tries, and passes; each narrows the logarithm of the ratio to a tenth.
TRIED, PASSES = 21, 8


def mixed_lm(df: DataFrame, y: str, xs: list[str], group: str) -> pd.DataFrame:
    """Random intercept per group by REML. A pass over the groups' moments tries TRIED ratios of the variances at once and
    gives one row for each of them; the next pass looks between the neighbours of the best."""
    names = ["_one", *xs, y]
    k = len(xs) + 1
    at = group_moments(df.dropna(subset=[y, *xs, group]).withColumn("_one", F.lit(1.0)), group, names)
    one = at.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("obs"), *_lower(k + 1, "q", lambda i, j: F.col(f"q_{i}_{j}"))).first()
    whole, obs = _square(one, "q", k + 1), one.obs

    def solve(m: np.ndarray, logs: float):
        xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
        beta = np.linalg.solve(xx, xy)
        sigma2 = max(yy - xy @ beta, 1e-300) / (obs - k)
        return (obs - k) * math.log(sigma2) + logs + np.linalg.slogdet(xx)[1], beta, sigma2, xx

    def tried(ratios: list[float]) -> list[tuple]:
        """(ratio, value, beta, sigma2, xx) of each."""
        rows = at.withColumn("r", F.explode(F.array(*map(F.lit, ratios))))
        w = F.col("r") / (1 + F.col("r") * F.col("n"))
        cells = _lower(k + 1, "m", lambda i, j: w * F.col(f"s_{i}") * F.col(f"s_{j}"))
        got = rows.groupBy("r").agg(F.sum(F.log1p(F.col("r") * F.col("n"))).alias("logs"), *cells).collect()
        return sorted((r.r, *solve(whole - _square(r, "m", k + 1), r.logs)) for r in got)

    steps = np.linspace(-12.0, 8.0, TRIED)
    found = [(0.0, *solve(whole, 0.0)), *tried(np.exp(steps).tolist())]
    for _ in range(PASSES):
        best = min(found, key=lambda f: f[1])
        if best[0] == 0.0:
            break
        width = (steps[1] - steps[0]) if len(steps) > 1 else 0.0
        steps = np.linspace(math.log(best[0]) - width, math.log(best[0]) + width, TRIED)
        found = [found[0], *tried(np.exp(steps).tolist())]
    ratio, _, beta, sigma2, xx = min(found, key=lambda f: f[1])
    se = np.sqrt(np.diag(np.linalg.inv(xx)) * sigma2)
    p = [math.erfc(abs(b / e) / math.sqrt(2)) for b, e in zip(beta, se)]
    out = pd.DataFrame({"term": ["intercept", *xs], "coef": beta, "se": se, "p": p})
    out["ci_low"], out["ci_high"] = out.coef - 1.959963984540054 * out.se, out.coef + 1.959963984540054 * out.se
    return out.assign(n_obs=int(obs), n_groups=one.g, group_var=ratio * sigma2, resid_var=sigma2)


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores over the whole table: one aggregate, then a projection; constant columns are dropped."""
    aggs = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("m", F.avg), ("s", F.stddev_samp))]
    r = df.agg(*aggs).first()
    out = {c: (F.col(c) - r[f"m_{c}"]) / r[f"s_{c}"] for c in columns if r[f"s_{c}"]}
    return df.drop(*[c for c in columns if c not in out]).withColumns(out)


def wide_summary(df: DataFrame, key: str, name: str, value: str, names: list[str] | None = None) -> DataFrame:
    """A row for each key: mean, deviation and count of the values of each name (some hundreds), in order of the names.
    Undefined means and deviations are null, which writers leave blank; undefined counts are 0."""
    names = sorted(names if names is not None else (r[0] for r in df.where(F.col(name).isNotNull()).select(name).distinct().collect()))
    aggs = F.round(F.avg(value) + 1e-9, 4).alias("mean"), F.round(F.stddev_samp(value) + 1e-9, 4).alias("std"), F.count(value).alias("count")
    return df.groupBy(key).pivot(name, names).agg(*aggs).fillna(0, [f"{n}_count" for n in names])


def varied(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with two values or more, nulls and NaN aside; one pass without distinct counts."""
    if not columns:
        return []
    number = {c for c, t in df.dtypes if t in ("double", "float")}
    value = {c: F.nanvl(F.col(c), F.lit(None)) if c in number else F.col(c) for c in columns}
    r = df.agg(*[(F.min(v) < F.max(v)).alias(c) for c, v in value.items()]).first()
    return [c for c in columns if r[c]]


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_a, n_b, missing, extra: whether two tables hold the same rows, whatever their order."""
    cols = sorted(a.columns)
    rows = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    d = rows.groupBy(*cols).agg(F.sum("_d").alias("d"), F.count_if(F.col("_d") > 0).alias("n_a"), F.count_if(F.col("_d") < 0).alias("n_b"))
    return d.agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("n_b"),
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("extra"),
    )


def same_numbers(ref: DataFrame, built: DataFrame, keys: list[str], rtol: float = 0.0, atol: float = 0.0) -> DataFrame:
    """ok, n_ref, n_built, n_off (values that differ, or rows that only one has), lacking (columns): whether a table is rebuilt.

    Rows meet by their keys. Numbers may differ by atol + rtol * |reference|; nulls equal nulls and NaN equals NaN.
    Columns that are not numbers are not compared; ``built`` may have more columns."""
    lacking = [c for c in ref.columns if c not in built.columns]
    numbers = [c for c, t in ref.dtypes if c not in keys + lacking and t.startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"))]
    a = ref.select(*keys, F.lit(1).alias("_a"), *[F.col(c).cast("double").alias(f"a_{c}") for c in numbers])
    b = built.select(*keys, F.lit(1).alias("_b"), *[F.col(c).cast("double").alias(f"b_{c}") for c in numbers])
    off = F.lit(0)
    for c in numbers:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        near = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(x), F.lit(False))
        off = off + F.when(near, 0).otherwise(1)
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    got = a.join(b, keys, "full").agg(
        F.count("_a").alias("n_ref"), F.count("_b").alias("n_built"), F.coalesce(F.sum(F.when(alone, 1).otherwise(off)), F.lit(0)).alias("n_off")
    )
    ok = (F.col("n_ref") == F.col("n_built")) & (F.col("n_off") == 0) & F.lit(not lacking)
    return got.select(ok.alias("ok"), "n_ref", "n_built", "n_off", F.lit(",".join(lacking)).alias("lacking"))


def series_z(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, sample deviation and count over the rows of keys, rounded."""
    agg = [F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.count(value).alias("n")]
    return df.groupBy(*keys).agg(*agg)


def first_by(df: DataFrame, keys: list[str], order: list, out: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*keys, *out)
