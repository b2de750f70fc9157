"""Title matching with tie refusal, and resumes by anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import jaccard
from scriptorium.sources.scratch import written


#: From so many titles on, a token's candidates are dealt over SALTS tasks.
COMMON, SALTS = 10_000, 16


def rare_first(df: DataFrame, key: str, norm: str, counts: DataFrame) -> DataFrame:
    """(key, tokens): the distinct tokens of a title as (n, t), the rarest by ``counts`` (t, n) first; titles without any go."""
    at = df.select(key, F.explode(F.array_distinct(F.split(norm, " "))).alias("t")).where("t <> ''")
    return at.join(counts.hint("merge"), "t").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("tokens"))


def title_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """paper_id, work_id, score of titles (paper_id, year, norm) and (work_id, wyear, wnorm) within a year of one another
    whose token sets overlap by ``least`` or more; an id once on each side.

    Tokens are ordered by how many titles hold them, rarest first. Two sizes of titles say how many tokens a pair must share,
    so how many of the first of each side hold the rarest shared one: titles meet by token, year and both sizes, and a pair
    counts at its rarest shared token alone. Tokens of COMMON titles or more, which lead only titles of common words, are
    dealt over SALTS. Nothing is broadcast: compressed tables of short rows are far larger in memory than on disk."""
    left, right = left.where("norm <> ''"), right.where("wnorm <> ''")
    words = left.select(F.explode(F.array_distinct(F.split("norm", " "))).alias("t")).unionByName(right.select(F.explode(F.array_distinct(F.split("wnorm", " "))).alias("t")))
    counts = written(words.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "tokens")

    def prefix(df: DataFrame, key: str, norm: str, year: str, tokens: str, own: str, other: str) -> DataFrame:
        """A row for each size of a partner and each token that may be the rarest shared one with it."""
        df = rare_first(df, key, norm, counts).join(df.select(key, F.col(year).alias("y")).hint("merge"), key)
        df = df.select(key, "y", "tokens", F.size("tokens").alias(own))
        sizes = F.sequence(F.ceil(F.col(own) * least - 1e-9).cast("int"), F.floor(F.col(own) / least + 1e-9).cast("int"))
        df = df.select("*", F.explode(sizes).alias(other))
        shared = F.greatest(F.ceil((F.col(own) + F.col(other)) * (least / (1 + least)) - 1e-9), F.lit(1))
        head = F.slice("tokens", F.lit(1), F.greatest(F.col(own) - shared + 1, F.lit(0)).cast("int"))
        return df.select(key, "y", own, other, F.transform("tokens", lambda x: x.t).alias(tokens), F.explode(head).alias("x")).select("*", "x.t", "x.n").drop("x")

    a = prefix(left, "paper_id", "norm", "year", "a", "na", "nb").withColumn("y", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)))
    b = prefix(right, "work_id", "wnorm", "wyear", "b", "nb", "na")
    common = F.lit(SALTS - 1)
    a = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") >= COMMON, common).otherwise(0)))).drop("n")
    b = b.withColumn("salt", F.when(F.col("n") >= COMMON, F.pmod(F.xxhash64("work_id"), F.lit(SALTS))).otherwise(0).cast("int")).drop("n")
    pairs = a.join(b.hint("merge"), ["t", "y", "na", "nb", "salt"])
    both = F.array_intersect("a", "b")  # in the order of a
    return pairs.where(F.col("t") == F.get(both, F.lit(0))).select("paper_id", "work_id", jaccard(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= least)


def pick_match(papers: DataFrame, works: DataFrame, least: float = 0.9, lead: float = 0.05) -> DataFrame:
    """paper_id, work_id, match_method of (paper_id, year, norm) against (work_id, wyear, wnorm, cites); an id once on each side.

    Candidates lie within a year. Equal titles win by year distance, then
    citations; if the best two tie, nothing is taken. Otherwise the best token
    overlap must reach ``least`` and lead the next by ``lead``; see title_pairs
    for how pairs of strangers are avoided. Works of one title and year are
    counted before they meet papers, and papers of one title and year, or of
    one token set and year, are matched once, so copies make no pairs.
    """
    by = works.where("wnorm <> ''").groupBy(F.col("wnorm").alias("norm"), "wyear", (-F.coalesce("cites", F.lit(0))).alias("less")).agg(F.min("work_id").alias("work_id"), F.count(F.lit(1)).alias("n"))
    by = by.groupBy("norm", "wyear").agg(F.min(F.struct("less", "work_id", "n")).alias("w"))
    titles = written(papers.where("norm <> ''").groupBy("norm", "year").agg(F.min("paper_id").alias("paper_id")), "titles")
    at = titles.withColumn("wyear", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)))
    same = at.join(by.hint("merge"), ["norm", "wyear"]).select("norm", "year", F.abs(F.col("wyear") - F.col("year")).alias("gap"), "w.*")
    same = same.groupBy("norm", "year", "gap", "less").agg(F.min("work_id").alias("work_id"), F.sum("n").alias("n"))
    same = same.groupBy("norm", "year").agg(F.min(F.struct("gap", "less", "work_id", "n")).alias("w"))
    tied = F.col("w.n") > 1
    exact = written(same.select("norm", "year", F.when(~tied, F.col("w.work_id")).alias("work_id"), F.when(tied, "ambiguous").otherwise("exact").alias("match_method")), "exact")

    words = lambda c: F.concat_ws(" ", F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))))
    rest = titles.join(exact.select("norm", "year").hint("merge"), ["norm", "year"], "left_anti").withColumn("words", words("norm"))
    sets = written(rest.where("words <> ''").groupBy("words", "year").agg(F.min("paper_id").alias("paper_id")), "token-sets")
    others = works.select(words("wnorm").alias("wnorm"), "wyear", "work_id").where("wnorm <> ''").groupBy("wnorm", "wyear").agg(F.min("work_id").alias("work_id"), F.count(F.lit(1)).alias("n"))
    others = written(others, "works")
    pairs = title_pairs(sets.withColumnRenamed("words", "norm"), others, least).join(others.select("work_id", "n").hint("merge"), "work_id")
    order = Window.partitionBy("paper_id").orderBy(F.desc("score"), "work_id")
    after = F.when(F.col("n") > 1, F.col("score")).otherwise(F.lead("score").over(order))
    best = pairs.withColumns({"rn": F.row_number().over(order), "next": after}).where("rn = 1")
    clear = F.col("next").isNull() | (F.col("score") - F.col("next") >= lead - 1e-12)
    fuzzy = best.select("paper_id", F.when(clear, F.col("work_id")).alias("work_id"), F.when(clear, "fuzzy").otherwise("ambiguous").alias("match_method"))
    fuzzy = sets.join(fuzzy.hint("merge"), "paper_id").drop("paper_id")
    fuzzy = rest.join(fuzzy.hint("merge"), ["words", "year"]).select("norm", "year", "work_id", "match_method")
    out = papers.select("paper_id", "norm", "year").join(exact.unionByName(fuzzy).hint("merge"), ["norm", "year"], "left")
    return out.select("paper_id", "work_id", F.coalesce("match_method", F.lit("none")).alias("match_method"))


def with_fallback(matched: DataFrame, by_doi: DataFrame) -> DataFrame:
    """Works found by identifier where the title gave none."""
    got = matched.join(by_doi.select("paper_id", F.col("work_id").alias("_doi")), "paper_id", "left")
    method = F.when(F.col("work_id").isNull() & F.col("_doi").isNotNull(), "doi").otherwise(F.col("match_method"))
    return got.select("paper_id", F.coalesce("work_id", "_doi").alias("work_id"), method.alias("match_method"))


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def pending_runs(papers: DataFrame, prompts: list[str], runs: int, done: DataFrame) -> DataFrame:
    """(paper_id, prompt) of which not every run is done."""
    one = F.explode(F.array(*map(F.lit, prompts)))
    wanted = papers.select("paper_id", one.alias("prompt"))
    counts = done.groupBy("paper_id", "prompt").agg(F.countDistinct("run").alias("n"))
    return wanted.join(counts, ["paper_id", "prompt"], "left").where(F.coalesce("n", F.lit(0)) < runs).drop("n")


def incomplete_years(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """year, n_papers, n_rows, complete."""
    a = papers.groupBy("year").agg(F.count(F.lit(1)).alias("n_papers"))
    b = rows.groupBy("year").agg(F.countDistinct("paper_id").alias("n_rows"))
    n = F.coalesce("n_rows", F.lit(0))
    return a.join(b, "year", "left").select("year", "n_papers", n.alias("n_rows"), (n >= F.col("n_papers")).alias("complete"))


def patched(papers: DataFrame, cache: DataFrame, more: DataFrame, key: str, text: str, order: str, least: int = 5, short: int = 30) -> DataFrame:
    """key, text, patched: texts replaced by those of the cache (key, new) with ``least`` words or more; one that is still of
    fewer than ``short`` words by the first, by ``order``, of the fallbacks (key, order, new) that has as many."""
    words = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != ""))
    cache = cache.where(words("new") >= least).groupBy(key).agg(F.first("new").alias("new"))
    more = more.where(words("new") >= short).groupBy(key).agg(F.min_by("new", order).alias("more"))
    at = papers.select(key, text).join(cache, key, "left")
    at = at.select(key, F.coalesce("new", text).alias(text), F.col("new").isNotNull().alias("patched")).join(more, key, "left")
    use = F.col("more").isNotNull() & (words(text) < short)
    return at.select(key, F.when(use, F.col("more")).otherwise(F.col(text)).alias(text), (F.col("patched") | use).alias("patched"))
