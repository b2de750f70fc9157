"""Nested bibliographic works to flat outcome rows, and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import arxiv_id
from scriptorium.operators.ranks import percentiles

WORK = (
    "id string, display_name string, publication_year int, cited_by_count int, ids map<string,string>, "
    "authorships array<struct<author:string>>, concepts array<struct<display_name:string,score:double>>, "
    "locations array<struct<source:struct<display_name:string>,landing_page_url:string,pdf_url:string>>, "
    "first_online_date string, doi string"
)


def best_concept(concepts: Column) -> Column:
    """Name of the concept of highest score, the first of equal ones."""
    ranked = F.transform(concepts, lambda c, i: F.struct(c.score.alias("s"), (-i).alias("i"), c.display_name.alias("n")))
    return F.array_max(ranked)["n"]


def work_arxiv_id(ids: Column, locations: Column) -> Column:
    """From the identifiers, else from locations that name the archive."""
    own = F.try_element_at(F.filter(F.transform(F.map_values(ids), arxiv_id), lambda x: x.isNotNull()), F.lit(1))
    url = lambda x: F.concat_ws(" ", x.landing_page_url, x.pdf_url)
    named = lambda x: F.lower(F.concat_ws(" ", x.source.display_name, url(x))).contains("arxiv")
    found = F.filter(F.transform(F.filter(locations, named), lambda x: arxiv_id(url(x))), lambda x: x.isNotNull())
    return F.coalesce(own, F.try_element_at(found, F.lit(1)))


def work_rows(works: DataFrame) -> DataFrame:
    """work_id, year, citations, author_count, subfield, arxiv_id, arxiv_v1_date."""
    return works.select(
        F.substring_index("id", "/", -1).alias("work_id"),
        F.col("publication_year").alias("year"),
        F.col("cited_by_count").alias("citations"),
        F.coalesce(F.nullif(F.size("authorships"), F.lit(-1)), F.lit(0)).alias("author_count"),
        best_concept(F.col("concepts")).alias("subfield"),
        work_arxiv_id(F.col("ids"), F.col("locations")).alias("arxiv_id"),
        F.col("first_online_date").alias("arxiv_v1_date"),
    )


def finalize(rows: DataFrame, census: int = 2026) -> DataFrame:
    """Citations by age, percentile within subfield and year, and whether a preprint came first (null without a date)."""
    age = F.greatest(F.lit(census) - F.col("year"), F.lit(1))
    posted = F.year(F.try_to_timestamp("arxiv_v1_date"))
    at = rows.withColumns({"cites_per_year": F.col("citations") / age, "preprint_before_conference": posted <= F.col("year")})
    return percentiles(at, "cites_per_year", "percentile", "subfield", "year")


def match_report(rows: DataFrame, *keys: str) -> DataFrame:
    """Counters of a matching stage."""
    some = F.count_if(F.col("work_id").isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), some.alias("matched"), (F.count(F.lit(1)) - some).alias("unmatched"))


def one_hot(column: str, values: list[str]) -> dict[str, Column]:
    """Dummies of the values in order, without the first."""
    return {f"{column}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in sorted(values)[1:]}
