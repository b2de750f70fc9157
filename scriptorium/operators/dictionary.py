"""Metrics that look words up in a list of any size, which is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.scratch import written

#: A list of at most so many words, of LONGEST letters on average, is sent to all workers: 20 MB of letters at most. Of tokens
#: that are held against a longer list, at most so many of the most frequent words are, none of more than LONGEST letters.
SMALL, LONGEST = 200_000, 100
#: Words are taken as frequent by steps of this share of a doubling of their counts.
STEP = 0.25


def _parts(word: Column) -> Column:
    return F.filter(F.split(F.lower(word), "-"), lambda p: p != "")


def _by_frequency(at: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the tokens' words: (word, listed) of the most frequent ones, at most SMALL; (word) of all others that are listed."""
    n = at.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = n.join(words.withColumn("listed", F.lit(True)), "word", "left")
    n = n.select("word", F.coalesce("listed", F.lit(False)).alias("listed"), F.floor(F.log2("n") / STEP).alias("step"))
    n = written(n.withColumn("step", F.when(F.length("word") <= LONGEST, F.col("step")).otherwise(-1)), "token-words")
    held, least = 0, None
    for step, k in sorted(n.where("step >= 0").groupBy("step").count().collect(), reverse=True):
        held += k
        if held > SMALL:
            break
        least = step
    often = F.lit(False) if least is None else F.col("step") >= least
    return n.where(often).select("word", "listed"), n.where(~often & F.col("listed")).select("word")


def count_listed(df: DataFrame, key: str, tokens: Column, words: DataFrame, parts: bool = False, small: int = SMALL) -> DataFrame:
    """(key, n_listed): how many of a row's tokens, repeats included, are in the list (word, in lower case).

    With ``parts`` a token is in it if any of its hyphenated parts is. Keys are unique; a key without listed tokens is
    absent. A list of at most ``small`` words, of LONGEST letters on average, goes to all workers, so only one sum for each
    key and task is shuffled. Of a longer one, what it says of the tokens' most frequent words does; only the other tokens
    are joined by word: rare words, of which none has many, and words of more than LONGEST letters, whatever their number."""
    words = words.select("word").where("word IS NOT NULL").distinct()
    one = F.posexplode(F.transform(tokens, _parts if parts else lambda t: F.array(F.lower(t)))).alias("pos", "parts")
    at = df.select(key, one)
    # Tokens of one part need no place: they are counted. Of the others, places are, as several parts may be listed.
    place = F.when(F.size("parts") > 1, F.col("pos"))
    at = at.select(key, place.alias("pos"), F.explode("parts").alias("word"))
    n, letters = words.limit(small + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    if n <= small and letters <= small * LONGEST:
        got = at.join(F.broadcast(words), "word", "left_semi").groupBy(key, "pos").agg(F.count(F.lit(1)).alias("n"))
    else:
        frequent, rare = _by_frequency(at, words)
        # A token of a frequent word is settled here and needs its word no more; that of another is looked up by it.
        at = at.join(F.broadcast(frequent), "word", "left").where("listed IS NULL OR listed")
        at = at.withColumn("word", F.when(F.col("listed").isNull(), F.col("word")))
        at = written(at.groupBy(key, "pos", "word").agg(F.count(F.lit(1)).alias("n")), "settled-tokens")
        others = at.where("word IS NOT NULL").join(rare, "word", "left_semi").select(key, "pos", "n")
        got = at.where("word IS NULL").select(key, "pos", "n").unionByName(others).groupBy(key, "pos").agg(F.sum("n").alias("n"))
    return got.groupBy(key).agg(F.sum(F.when(F.col("pos").isNull(), F.col("n")).otherwise(1)).alias("n_listed"))


def with_listed(df: DataFrame, key: str, tokens: Column, words: DataFrame, keep: dict[str, Column], parts: bool = False) -> DataFrame:
    """key, the columns of ``keep`` and n_listed of every row; only those, never texts, meet the counts by key."""
    rows = df.select(key, *[c.alias(k) for k, c in keep.items()])
    got = rows.join(count_listed(df, key, tokens, words, parts), key, "left")
    return got.withColumn("n_listed", F.coalesce("n_listed", F.lit(0).cast("long")))
