"""Rules that a processed record must keep, as one array of those it breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens

#: The rules' bounds.
VENUES = ("neurips", "iclr", "icml", "arxiv")
YEARS = (1987, 2030)
LEAST_TITLE, LEAST_ABSTRACT = 1, 5


def violations(
    paper_id: Column, venue: Column, year: Column, title: Column, abstract: Column, authors: Column, categories: Column, primary: Column
) -> Column:
    """Names of broken rules, in this order. A null breaks the rule of its column; only arXiv papers may, and must, have categories."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    arxiv = F.coalesce(venue == "arxiv", F.lit(False))
    rules = {
        "paper_id": blank(paper_id),
        "venue": ~F.coalesce(venue.isin(*VENUES), F.lit(False)),
        "year": ~F.coalesce(year.between(*YEARS), F.lit(False)),
        "title": F.size(tokens(title)) < LEAST_TITLE,
        "abstract": F.size(tokens(abstract)) < LEAST_ABSTRACT,
        "authors": F.coalesce((F.size(authors) < 1) | F.exists(authors, blank), F.lit(True)),
        "arxiv": F.when(arxiv, (F.coalesce(F.size(categories), F.lit(0)) < 1) | blank(primary)).otherwise(categories.isNotNull()),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
