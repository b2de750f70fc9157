"""Hand-label sheets: values within bounds, and what is wrong with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_labels(sheet: DataFrame, bounds: dict[str, tuple[int, int]], id_col: str = "paper_id") -> DataFrame:
    """paper_id, prompt, value, error for each row of a sheet and prompt (a column of strings); one of the last two is null.

    A value is a number, cut to an integer, within its prompt's bounds. Errors: ``empty`` (null or blank), ``not an integer``,
    ``outside [a,b]``. A null paper_id keeps its rows."""
    long = sheet.select(F.col(id_col).cast("string").alias("paper_id"), *bounds).unpivot("paper_id", list(bounds), "prompt", "raw")
    number = F.trim("raw").try_cast("double")
    number = F.when(F.abs(number) < 2.0**62, number).cast("long")  # neither infinite nor NaN
    low, high = (F.create_map(*[F.lit(x) for k, b in bounds.items() for x in (k, b[i])])[F.col("prompt")] for i in (0, 1))
    at = long.withColumns({"_v": number, "_low": low, "_high": high})
    error = F.when(F.trim(F.coalesce("raw", F.lit(""))) == "", "empty").when(F.col("_v").isNull(), "not an integer")
    error = error.when(~F.col("_v").between(F.col("_low"), F.col("_high")), F.format_string("outside [%d,%d]", "_low", "_high"))
    return at.withColumn("error", error).select("paper_id", "prompt", F.when(F.col("error").isNull(), F.col("_v")).alias("value"), "error")


def first_errors(labels: DataFrame, most: int = 20) -> DataFrame:
    """The first errors by paper and prompt: a report of ``most`` lines."""
    return labels.where("error IS NOT NULL").orderBy("paper_id", "prompt", "error").limit(most).select("paper_id", "prompt", "error")


def checked(labels: DataFrame, most: int = 20) -> DataFrame:
    """paper_id, prompt, value in order; ValueError with the first errors if there are any."""
    bad = first_errors(labels, most).collect()
    if bad:
        more = labels.where("error IS NOT NULL").count() - len(bad)
        lines = [f"{r.paper_id}: {r.prompt} {r.error}" for r in bad] + [f"and {more} more"] * (more > 0)
        raise ValueError("labels are invalid:\n  " + "\n  ".join(lines))
    return labels.select("paper_id", "prompt", "value").orderBy("paper_id", "prompt")
