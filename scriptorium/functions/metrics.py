"""Metrics of texts as objects: any number of them in one projection over one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Metric:
    """A name and one of two ways to compute it: an expression of the text's column, or a function of a text.

    An expression is a Column of any type. A function gets a text that is not null and returns what ``kind``, a Spark type
    in DDL, holds; what it raises becomes an entry in the row's errors, and the metric is null there."""

    name: str
    expression: Callable[[Column], Column] | None = None
    function: Callable[[str], object] | None = None
    kind: str = "double"

    def __post_init__(self):
        if (self.expression is None) == (self.function is None):
            raise ValueError(f"{self.name}: an expression or a function is needed, not both")


def _all_functions(metrics: list[Metric]):
    """One function for all metrics that are functions: a struct of their values, and of the errors."""
    fields = [T.StructField(m.name, T.StructType.fromDDL(f"v {m.kind}")["v"].dataType) for m in metrics]
    error = T.StructType.fromDDL("metric string, error string")
    schema = T.StructType([*fields, T.StructField("errors", T.ArrayType(error))])

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {f.name: [] for f in schema}
        for text in texts:
            errors = []
            for m in metrics:
                value = None
                if text is not None:
                    try:
                        value = m.function(text)
                    except Exception as e:
                        errors.append({"metric": m.name, "error": f"{type(e).__name__}: {e}"})
                out[m.name].append(value)
            out["errors"].append(errors)
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items()})

    return run


def apply(df: DataFrame, text: str, metrics: Iterable[Metric], keep: Iterable[str] = ()) -> DataFrame:
    """The columns of ``keep``, one for each metric, and errors (metric, error). A row that fails in one keeps the others.

    Metrics that are functions run in one Python stage, whatever their number. A null text has null from functions."""
    metrics = list(metrics)
    names = [m.name for m in metrics]
    if len({*names, *keep, "errors"}) < len(names) + len(list(keep)) + 1:
        raise ValueError("metrics and kept columns need names of their own, none of them errors")
    own = [m for m in metrics if m.function]
    at = df.select(*keep, *[m.expression(F.col(text)).alias(m.name) for m in metrics if m.expression], *([_all_functions(own)(text).alias("_own")] if own else []))
    none = F.array().cast("array<struct<metric:string,error:string>>")
    columns = [F.col(f"_own.{m.name}").alias(m.name) if m.function else F.col(m.name) for m in metrics]
    return at.select(*keep, *columns, (F.col("_own.errors") if own else none).alias("errors"))
