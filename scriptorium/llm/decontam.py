"""Benchmark decontamination: rare n-gram seeds join documents to test items, alignment scores the pairs.

Words are runs of letters and digits, lower-cased. The corpus frequency of each
word that the benchmark uses is counted over all documents. A seed is three
words in a row of an item; it is rare if, at these frequencies, it would stand
by chance at fewer than ``chance`` of all places, and each item keeps at least
its ``least`` rarest ones. That measures chance, not copies, so an item copied a
thousand times keeps its seeds. Documents are scanned for the seeds; around the
hits of an item a Smith-Waterman alignment of words (match 2, mismatch and gap
-1) scores the passage, so reordered or edited copies still count.

``score`` is the alignment's over that of a full copy. A pair is reported if it
reaches ``min_score``, or if the alignment is worth ``min_words`` matching words
(a part of a long item).

The benchmark is taken in blocks of about ``block_items`` items and ``block_bytes``
bytes, each against all documents, so what a worker holds is bounded however long
the benchmark and its items are (an item longer than that is held whole).

Cases: null and empty texts on either side have no seeds and give no pair; items
of fewer than three words give none; repeated rows on either side give repeated
pairs; very long documents are scanned whole and aligned only around hits; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and digits of ASCII and all bytes beyond it stay; others part words.
_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MATCH = 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_WORDS).split()


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, end in item, end in window), ends inclusive."""
    steps = np.arange(len(window) + 1)
    above = np.zeros(len(window) + 1, np.int64)
    best = (0, -1, -1)
    for i, w in enumerate(item):
        here = np.maximum(above - 1, 0)
        here[1:] = np.maximum(here[1:], above[:-1] + np.where(window == w, MATCH, -1))
        here = np.maximum.accumulate(here + steps) - steps
        j = int(here.argmax())
        if here[j] > best[0]:
            best = (int(here[j]), i, j - 1)
        above = here
    return best


class Items:
    """Test items as word ids, and their rare seeds."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [r[0] for r in rows]
        texts = [words_of(r[1]) for r in rows]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.words = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]

    def choose(self, frequency: np.ndarray, chance: float, least: int) -> None:
        size = max(len(self.vocabulary), 1)
        logs = np.log(np.maximum(frequency, 1e-12))
        keys, items, places = [], [], []
        for k, w in enumerate(self.words):
            if len(w) < 3:
                continue
            odds = logs[w[:-2]] + logs[w[1:-1]] + logs[w[2:]]
            rare = odds <= np.log(chance)
            rare[np.argsort(odds, kind="stable")[:least]] = True
            at = np.flatnonzero(rare)
            keys.append(np.stack([w[at] * size + w[at + 1], w[at + 2]]))
            items.append(np.full(len(at), k))
            places.append(at)
        empty = np.zeros(0, np.int64)
        two, last = np.concatenate(keys, axis=1) if keys else (empty, empty)
        items, places = (np.concatenate(x) if x else empty for x in (items, places))
        # First two words by their number among the seeds': a key is below seeds * size, whatever the words of a block.
        self.pairs, pair = np.unique(two, return_inverse=True)
        keys = pair * size + last
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.places = keys[order], items[order], places[order]

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words_of(text)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in the text where the item would begin) of each seed found."""
        size, none = len(self.vocabulary), np.zeros(0, np.int64)
        if len(ids) < 3 or not len(self.keys):
            return none, none
        at = np.flatnonzero((ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0))
        two = ids[at] * size + ids[at + 1]
        pair = np.minimum(np.searchsorted(self.pairs, two), len(self.pairs) - 1)
        same = self.pairs[pair] == two
        at, pair = at[same], pair[same]
        key = pair * size + ids[at + 2]
        a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = b - a
        rows = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.items[rows], np.repeat(at, n) - self.places[rows]

    def leaks(self, text: str | None, min_score: float, min_words: int) -> list[tuple[int, float, int, int]]:
        """(item id, score, first word, words) of each passage found."""
        ids = self.numbers(text)
        items, begins = self.hits(ids)
        out = []
        for k in np.unique(items):
            item, own = self.words[k], np.sort(begins[items == k])
            slack = len(item) // 4 + 3
            found = []
            for group in np.split(own, np.flatnonzero(np.diff(own) > len(item) // 2) + 1):
                a, b = max(int(group[0]) - slack, 0), int(group[-1]) + len(item) + slack
                window = ids[a:b]
                worth, i, j = align(item, window)
                if worth >= min_score * MATCH * len(item) or worth >= MATCH * min_words:
                    _, _, back = align(item[i::-1], window[j::-1])
                    found.append((worth / (MATCH * len(item)), a + j - back, back + 1))
            last = -1
            for score, first, n in sorted(found, key=lambda f: f[1]):
                if first > last:
                    out.append((self.ids[k], score, first, n))
                    last = first + n - 1
        return out


def _frequency(docs: DataFrame, items: Items) -> np.ndarray:
    """Share of all words of the corpus that each word of the items has."""
    held, size = docs.sparkSession.sparkContext.broadcast(items), len(items.vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size + 1, np.int64)
        for x in batches:
            for t in x["text"]:
                counts += np.bincount(held.value.numbers(t) + 1, minlength=size + 1)
        yield pd.DataFrame({"k": np.arange(size + 1), "n": counts})

    got = docs.select("text").mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size + 1)
    for r in got:
        counts[r.k] = r.n
    return counts[1:] / max(counts.sum(), 1)


def _blocks(docs: DataFrame, benchmark: DataFrame, chance: float, least: int, block_items: int, block_bytes: int) -> Iterator:
    """Broadcast items of each block of the benchmark, with their seeds."""
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    size = tests.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // block_items), -(-size.bytes // block_bytes))
    for k in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = Items([(r.item_id, r.text) for r in block.collect()])
        items.choose(_frequency(docs, items), chance, least)
        yield docs.sparkSession.sparkContext.broadcast(items)


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    chance: float = 1e-8,
    least: int = 4,
    min_score: float = 0.4,
    min_words: int = 24,
    block_items: int = 5000,
    block_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, score, first_word, n_words of each passage of a test item in a document."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, n_words long"
    names = [c.split()[0] for c in schema.split(", ")]
    out = None
    for held in _blocks(docs, benchmark, chance, least, block_items, block_bytes):

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            own = held.value
            for x in batches:
                rows = [(d, *r) for d, t in zip(x["doc_id"], x["text"]) for r in own.leaks(t, min_score, min_words)]
                yield pd.DataFrame(rows, columns=names)

        found = docs.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    chance: float = 1e-8,
    least: int = 4,
    min_score: float = 0.4,
    min_words: int = 24,
    block_items: int = 5000,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of df in which no test item is found."""

    def leaking(held):
        @F.pandas_udf("boolean")
        def run(text: pd.Series) -> pd.Series:
            own = held.value
            return pd.Series([bool(own.leaks(t, min_score, min_words)) for t in text], dtype=bool)

        return run("text")

    for held in list(_blocks(df.select("text"), benchmark, chance, least, block_items, block_bytes)):
        df = df.where(~leaking(held))
    return df
