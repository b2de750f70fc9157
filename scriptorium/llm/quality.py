"""Quality rules: plain counts of each text and a hashed n-gram likelihood ratio, in DataFrame functions only.

Words and pairs of neighbouring words are hashed to ``2 ** bits`` buckets. Two multinomials over the buckets are counted: of the
target, documents that labels call good, and of the raw corpus, all documents.
A document's score is the mean over its features of
``log(p_target / p_raw)``; it is kept if that reaches ``threshold``. Nothing is
drawn at random, so the same tables give the same verdicts.

The target is fitted on a bounded sample of labelled rows: of those with quality
1 and toxic 0, the ``max_target`` ids first by hash. Ids of that sample are
broadcast (at most ``max_target`` longs), and the two multinomials are
``2 ** bits`` rows at any size of the corpus.

Cases: a null or empty text has no word, fails the base rules and scores 0;
repeated rows are judged alike and all stay; without any label the target equals
the corpus, so every score is 0; other columns are not read; an empty table
gives an empty result. Repeated windows are told by a 64-bit hash of
their three words within one text (of 20,000 words two differ and agree with
probability 1e-11).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import spaced, words_column

SYMBOLS = "#*$%&|<>"
#: Target features assumed for an average bucket before any is seen.
PRIOR = 32


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _rest(c: Column | str, n: int) -> Column:
    """An array without its first n items."""
    return F.slice(c, F.lit(n + 1), F.greatest(F.size(c) - n, F.lit(0)))


def _pairs(a: Column | str, b: Column | str, n: int) -> Column:
    """Hashes of a[i] with b[i + n], as many as b has left."""
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(b) - n, F.lit(0))), _rest(b, n), lambda x, y: F.xxhash64(x, y))


def counted(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, one and two (hashes of words and of pairs) and the counts of each text that need no other text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = docs.select("doc_id", *more, text.alias("text"), spaced(F.col("text")).alias("spaced"))
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = at.select(
        "doc_id",
        *more,
        F.transform(F.array_remove(F.split("spaced", " ", -1), ""), lambda w: F.xxhash64(w)).alias("one"),
        lines.alias("lines"),
        F.length(F.replace("spaced", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(bare)).cast("long").alias("n_symbols"),
    )
    at = at.withColumn("two", _pairs("one", "one", 1))
    at = at.withColumn("three", _pairs("two", "one", 2))
    # Only a text that has a hash twice needs its windows sorted.
    twice = F.size(F.array_distinct("three")) < F.size("three")
    placed = F.sort_array(F.transform("three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = at.withColumn("sorted", F.when(twice, placed).otherwise(_empty("struct<h:bigint,i:int>")))
    same = F.zip_with("sorted", _rest("sorted", 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(_empty("int")))
    starts = F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))
    at = at.withColumn("starts", starts)
    covered = F.flatten(F.transform("starts", lambda i: F.array(i, i + 1, i + 2)))
    return at.select(
        "doc_id",
        *more,
        "one",
        "two",
        F.size("one").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
    )


def bucket(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame, bits: int, max_target: int) -> list[float]:
    """log(p_target / p_raw) of each bucket; 0 for a bucket nothing fell in.

    The corpus is smoothed by one of each bucket, the target by the corpus, at PRIOR for an average bucket, so that
    a small target says little about buckets it has hardly seen.
    """
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).withColumn("target", F.lit(1))
    at = docs.select("doc_id", F.transform(words_column(F.col("text")), lambda w: F.xxhash64(w)).alias("one"))
    at = at.join(F.broadcast(good), "doc_id", "left")
    at = at.select("target", F.explode(F.concat("one", _pairs("one", "one", 1))).alias("h"))
    at = at.groupBy(bucket(F.col("h"), bits).alias("b"))
    rows = at.agg(F.count(F.lit(1)).alias("raw"), F.count("target").alias("good")).collect()
    n_raw, n_good, size = sum(r.raw for r in rows), sum(r.good for r in rows), 2**bits
    out, prior = [0.0] * size, PRIOR * size
    for r in rows if n_good else ():
        p = (r.raw + 1) / (n_raw + size)
        out[r.b] = math.log((r.good + 1 + prior * p) / (n_good + size + prior)) - math.log(p)
    return out


def _judged(
    docs: DataFrame, labels: DataFrame, bits: int, max_target: int, threshold: float, *more: str
) -> DataFrame:
    table = ",".join(map(repr, log_ratios(docs, labels, bits, max_target)))
    weights = F.split(F.lit(table), ",").cast("array<double>")
    at = counted(docs, *more)
    total = F.aggregate(F.concat("one", "two"), F.lit(0.0), lambda a, h: a + F.element_at(weights, bucket(h, bits) + 1))
    at = at.withColumn("score", total / F.greatest(F.size("one") + F.size("two"), F.lit(1)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    at = at.withColumn("base_failed", failed)
    return at.drop("one", "two").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = 14,
    max_target: int = 20000,
    threshold: float = -0.03,
) -> DataFrame:
    """A row for each document: its counts, base_failed, score and kept."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _judged(docs, labels, bits, max_target, threshold)


def keep_good(df: DataFrame, labels: DataFrame, bits: int = 14, max_target: int = 20000, threshold: float = -0.03) -> DataFrame:
    """The rows of df (doc_id, text and any others) that are kept; nothing is shuffled but counts."""
    docs = df.select("doc_id", "text", F.struct(*df.columns).alias("whole"))
    judged = _judged(docs, labels, bits, max_target, threshold, "whole")
    # A filter would move below the projections that make the verdict and repeat them; it does not pass a generator.
    judged = judged.select(F.inline(F.array(F.struct("whole", "kept"))))
    return judged.where("kept").select("whole.*")
