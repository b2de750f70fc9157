"""Metrics of parsed sentences: depth, clauses, passives, noun phrases, lemmas.

A row is a sentence: an array of tokens (head: place of the token it hangs on,
from 0, a root's own place; relation; tag; lemma). Spark's tasks take sentences
in Arrow batches and count over the tokens of SOME sentences, or MANY tokens, as
one array: pointers are followed in doubling rounds, and only those not yet at
their end are. Documents are then sums over their sentences, so only a few
numbers and different lemmas of each are shuffled.

Cases: a null or empty sentence is none; a document without one has no row;
a head outside the sentence counts as none of its tokens' parents (the token is
a root); null tags, relations or lemmas match nothing. Trees are taken to be
projective: the leftmost token below a token is found by its first children.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from scriptorium.functions import lexicons as L

COUNTS = ("depth", "clauses", "passive", "chunks", "words", "content")


def _followed(at: np.ndarray) -> np.ndarray:
    """Where each place leads if its pointer, which goes left or to itself, is followed to the end."""
    at, open_ = at.copy(), np.arange(len(at))
    while len(open_):
        on = at[at[open_]]
        open_, on = open_[on != at[open_]], on[on != at[open_]]
        at[open_] = on
    return at


def _depths(heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Longest way to a root in each sentence, its size at most (a ring has no root); ways double in each round."""
    at, steps = heads.copy(), (heads != np.arange(len(heads))).astype(np.int64)
    open_ = np.flatnonzero(steps)
    for _ in range(int(sizes.max()).bit_length()):
        more = steps[at[open_]]
        open_, more = open_[more > 0], more[more > 0]
        if not len(open_):
            break
        on = at[at[open_]]
        steps[open_] += more
        at[open_] = on
    return np.minimum(np.maximum.reduceat(steps, sizes.cumsum() - sizes), sizes)


def _among(c: pa.Array, values: tuple[str, ...]) -> np.ndarray:
    return pc.is_in(c, pa.array(values, c.type)).to_numpy(zero_copy_only=False)


def _counted(tokens: pa.ListArray) -> list[pa.Array]:
    """COUNTS and the content words' lemmas of sentences that have tokens."""
    sizes = pc.list_value_length(tokens).to_numpy().astype(np.int64)
    ends = sizes.cumsum()
    starts, flat = ends - sizes, tokens.flatten()
    head, relation, tag, lemma = (pc.struct_field(flat, k) for k in ("head", "relation", "tag", "lemma"))
    i, first = np.arange(len(flat)), np.repeat(starts, sizes)
    h = pc.fill_null(head.cast(pa.int64()), -1).to_numpy()
    heads = np.where((h >= 0) & (h < np.repeat(sizes, sizes)), h + first, i)
    conj, phrase = _among(relation, ("conj",)), _among(relation, L.PHRASE_RELATIONS)
    joined = _followed(np.where(conj & (heads < i), heads, i))
    left = i.copy()
    np.minimum.at(left, heads, i)
    left = _followed(left)
    ok = np.flatnonzero(_among(tag, L.NOUN_TAGS) & (phrase | (conj & phrase[joined[heads]])))
    # A phrase that begins before the end of the one before it is part of no new one; none reaches into another sentence.
    last, kept = -1, []
    for start, end in zip(left[ok].tolist(), ok.tolist()):
        if start > last:
            last = end
            kept.append(end)
    sums = lambda c: np.add.reduceat(c.astype(np.int64), starts)
    chunks = np.zeros(len(i), bool)
    chunks[kept] = True
    content = _among(tag, L.CONTENT_TAGS)
    n_content = sums(content)
    numbers = [_depths(heads, sizes), sums(_among(relation, L.CLAUSE_RELATIONS)), sums(_among(relation, L.PASSIVE_RELATIONS)) > 0]
    numbers += [sums(chunks), sums(~_among(tag, L.GAP_TAGS)), n_content]
    at = pa.array(np.concatenate([[0], n_content.cumsum()]), pa.int32())
    return [*(pa.array(x.astype(np.int32)) for x in numbers), pa.ListArray.from_arrays(at, lemma.filter(pa.array(content)).cast(pa.string()))]


#: Sentences, and tokens unless one sentence has more, that are counted at one time.
SOME, MANY = 10_000, 1_000_000


def sentence_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """df without its tokens, with the counts of each sentence that has any: depth, clauses, passive, chunks, words, content, lemmas."""
    others = [f for f in df.schema.fields if f.name != tokens]
    # Columns of any names and types go with the tokens under names of their own.
    own = [StructField(f"_{k}", f.dataType) for k, f in enumerate(others)]
    counts = [*(StructField(c, IntegerType()) for c in COUNTS), StructField("lemmas", ArrayType(StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            x = x.filter(pc.fill_null(pc.greater(pc.list_value_length(x["tokens"]), 0), False))
            ends = pc.list_value_length(x["tokens"]).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
            at = 0
            while at < len(x):
                past = ends[at - 1] if at else 0
                n = min(SOME, max(1, int(np.searchsorted(ends, past + MANY, "right")) - at))
                some = x.slice(at, n)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *_counted(some["tokens"])], names=[f.name for f in (*own, *counts)])
                at += n

    sent = df.select(*[F.col(f"`{f.name}`").alias(f"_{k}") for k, f in enumerate(others)], F.col(tokens).alias("tokens"))
    got = sent.mapInArrow(run, StructType([*own, *counts]))
    lemmas = F.array_distinct(F.transform("lemmas", lambda x: F.lower(x)))
    return got.select(*[F.col(f"_{k}").alias(f.name) for k, f in enumerate(others)], *COUNTS, lemmas.alias("lemmas"))


def parsed_metrics(df: DataFrame, id_col: str, tokens: str = "tokens") -> DataFrame:
    """For each id: sentences, parse_depth, clauses_per_sentence, passive_rate, np_density, ttr."""
    counts = sentence_counts(df.select(id_col, tokens), tokens)
    got = counts.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("sentences"),
        *(F.sum(c).alias(c) for c in ("depth", "clauses", "passive", "chunks", "words", "content")),
        F.size(F.array_distinct(F.flatten(F.collect_list("lemmas")))).alias("lemmas"),
    )
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)) + 1e-9, 6)
    return got.select(
        id_col,
        "sentences",
        share("depth", "sentences").alias("parse_depth"),
        share("clauses", "sentences").alias("clauses_per_sentence"),
        share("passive", "sentences").alias("passive_rate"),
        share("chunks", "words").alias("np_density"),
        share("lemmas", "content").alias("ttr"),
    )
