"""Language-model scoring by Brown classes.

Texts are lowered (A-Z) and cut to words; each ends with one end token. Training
documents give the count of every word. The ``n_types`` most frequent words are
types of their own; any other word belongs to one of ``n_signatures`` types by
its last three bytes. Bigrams of types are counted over the whole training
corpus, and exchange clustering moves type after type to the class that raises
the class bigram likelihood most, until a round moves none or ``rounds`` are
done. Then every further word of the head (below) with ``n_least`` occurrences
becomes a type too, at first in the class of its ending. In each of at most
``more_rounds`` rounds the classes before and after each of these are counted
over the corpus, and each goes to the class that they fit best, all at once; a
round that does not raise the likelihood is dropped and the last. Endings class
only rarer words. The end token is a class alone. A token's probability is::

    P(class | class before) * P(word | class)
    (n(c', c) + 1) / (n(c') + classes) * (n(w) + 1) / (n(c) + v(c) + 1)

with v(c) the distinct words of a class; an unseen word takes the one spare place
of the class that its ending gives.

Counts of all words stay in a table. Words that are frequent (at most
``n_head``, found from a histogram of counts) go to the workers; a text's other
words are joined to the table by shuffle, and none of those is hot, being rarer.
Only the head, the bigrams of the first types (at most (n_types + n_signatures +
1) ** 2) and of classes, counts by type and classes of head words reach the driver.

Cases: a null or empty text is its end token alone; with no training text every
count is 0; a null id is trained on; repeated rows count, and are scored, one by
one; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written

END = b"\n"
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Words as bytes (bytes.split cuts at the six white-space characters), then the end."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary), n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        out = lambda: pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
        for x in batches:
            for t in x["text"]:
                held.update(tokens(t))
                if len(held) > FLUSH:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return train.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_limit(counts: DataFrame, n_head: int) -> int:
    """A count that at most n_head words reach; histogram of at most some thousand rows."""
    level = F.floor(F.log2("n") * 32).cast("int")
    total, least = 0, None
    rows = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    for r in rows.orderBy(F.desc("level")).collect():
        total += r.words
        if total > n_head:
            break
        least = r.least
    return least if least is not None else (1 << 62)


def _signature(word: bytes, n_types: int, n_signatures: int) -> int:
    return n_types + 1 + zlib.crc32(word[-3:]) % n_signatures


class Types:
    """Type of a word: 0 the end, then the most frequent ones, then signatures, then the head's other words of n_least at least."""

    def __init__(self, head: dict[bytes, int], n_types: int, n_signatures: int, n_least: int):
        self.n_types, self.n_signatures = n_types, n_signatures
        first = sorted((w for w in head if w != END), key=lambda w: (-head[w], w))
        #: Place in head order; the end is always there.
        self.words = [END, *first]
        self.place = {w: i for i, w in enumerate(self.words)}
        self.counts = np.array([head.get(w, 0) for w in self.words], np.float64)
        own = list(range(min(n_types + 1, len(self.words))))
        rest = np.array([_signature(w, n_types, n_signatures) for w in self.words[len(own) :]], np.int64)
        #: Types below this one take part in the exchange one by one.
        self.n_first = n_types + 1 + n_signatures
        n_more = int((self.counts[len(own) :] >= n_least).sum())
        self.types = np.array([*own, *range(self.n_first, self.n_first + n_more), *rest[n_more:]], np.int64)
        #: Of each type: the one of the first types that stands for it at first.
        self.start = np.concatenate([np.arange(self.n_first), rest[:n_more]])
        self.total = self.n_first + n_more

    def own(self) -> Iterator[tuple[bytes, int, int]]:
        """Word, type and count of words that are types of their own."""
        for w, t, n in zip(self.words, self.types.tolist(), self.counts.tolist()):
            if t <= self.n_types or t >= self.n_first:
                yield w, t, int(n)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the head (-1: not in it) and types."""
        get, a, b = self.place.get, self.n_types, self.n_signatures
        places = np.array([get(w, -1) for w in words], np.int64)
        types = self.types[places]
        for i in np.flatnonzero(places < 0):
            types[i] = _signature(words[i], a, b)
        return places, types


def encoded(train: DataFrame, types: Types) -> DataFrame:
    """types (int32 as binary): those of some texts in a row; the end stands before each text too."""
    held = train.sparkSession.sparkContext.broadcast(types)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts, out = x["text"].tolist(), []
            for at in range(0, len(texts), 200):
                words = [END]
                for t in texts[at : at + 200]:
                    words += tokens(t)
                out.append(held.value.of(words)[1].astype(np.int32).tobytes())
            yield pd.DataFrame({"types": out})

    return written(train.select("text").mapInPandas(run, "types binary"), "types")


def bigrams(codes: DataFrame, group: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbouring groups, group giving that of each type."""
    held = codes.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size * size, np.int64)
        for x in batches:
            for row in x["types"]:
                k = held.value[np.frombuffer(row, np.int32)]
                counts += np.bincount(k[:-1] * size + k[1:], minlength=size * size)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"k": some, "n": counts[some]})

    got = codes.mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(bigrams: np.ndarray, n_classes: int, rounds: int) -> np.ndarray:
    """Class of each type; class n_classes is the end's alone."""
    n = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = [t for t in np.argsort(-weight, kind="stable") if t]
    of = np.zeros(n, np.int64)
    of[0] = n_classes
    for i, t in enumerate(order):
        of[t] = i % n_classes
    member = np.zeros((n, n_classes + 1))
    member[np.arange(n), of] = 1
    table = member.T @ bigrams @ member
    for _ in range(rounds):
        moved = 0
        for t in order:
            if not weight[t]:
                continue
            a, self_n = of[t], bigrams[t, t]
            out, into = bigrams[t] @ member, bigrams[:, t] @ member
            out[a] -= self_n
            into[a] -= self_n
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= self_n
            base = _f(table)
            right, left = _f(table + out) - base, _f(table + into[:, None]) - base
            row, col, d = table.sum(1), table.sum(0), np.diag(table)
            gain = right.sum(1) - np.diag(right) + left.sum(0) - np.diag(left) + _f(d + out + into + self_n) - _f(d)
            gain -= _f(row + out.sum() + self_n) - _f(row) + _f(col + into.sum() + self_n) - _f(col)
            gain[n_classes] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            moved += b != a
            member[t, a], member[t, b], of[t] = 0, 1, b
            table[b] += out
            table[:, b] += into
            table[b, b] += self_n
        if not moved:
            break
    return of


#: Words whose counts go from task to task in one piece.
BLOCK = 256


def best_classes(out: np.ndarray, into: np.ndarray, now: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class that fits each word's classes after (out) and before (into) it best; the word itself is taken out of its class."""
    log = lambda x: np.log(np.maximum(x, 0) + 0.5)
    row, col, n, m = table.sum(1), table.sum(0), out.sum(1), into.sum(1)
    fit = out @ log(table).T + into @ log(table) - n[:, None] * log(row) - m[:, None] * log(col)
    stay = (out * log(table[now] - out)).sum(1) + (into * log(table.T[now] - into)).sum(1)
    stay -= n * log(row[now] - n) + m * log(col[now] - m)
    fit[:, -1] = -np.inf
    fit[np.arange(len(now)), now] = stay + 1e-9
    return fit.argmax(1)


def moved(codes: DataFrame, types: Types, classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes after one round over the types from n_first on."""
    held, size, first, n = codes.sparkSession.sparkContext.broadcast((classes, table)), len(table), types.n_first, types.total - types.n_first
    wide = 2 * size

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, counts = held.value[0], np.zeros(n * wide, np.int32)
        for x in batches:
            for row in x["types"]:
                k = np.frombuffer(row, np.int32).astype(np.int64)
                c, t = of[k], (k - first) * wide
                some = t >= 0
                np.add.at(counts, (t[:-1] + c[1:])[some[:-1]], 1)
                np.add.at(counts, (t[1:] + size + c[:-1])[some[1:]], 1)
        at = np.flatnonzero(counts)
        cuts = np.searchsorted(at, np.arange(0, n + BLOCK, BLOCK) * wide)
        rows = [(b, zlib.compress(np.stack([at[i:j] - b * BLOCK * wide, counts[at[i:j]]]).astype(np.int32).tobytes(), 1)) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        yield pd.DataFrame(rows, columns=["block", "counts"])

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        of, whole = held.value
        b = int(x["block"].iloc[0])
        counts = np.zeros(BLOCK * wide)
        for row in x["counts"]:
            at, some = np.frombuffer(zlib.decompress(row), np.int32).reshape(2, -1)
            counts[at] += some
        now = of[first + b * BLOCK : first + (b + 1) * BLOCK]
        counts = counts.reshape(BLOCK, wide)[: len(now)]
        best = best_classes(counts[:, :size], counts[:, size:], now, whole)
        return pd.DataFrame({"type": first + b * BLOCK + np.arange(len(now)), "class": best})

    got = codes.mapInPandas(count, "block int, counts binary").groupBy("block").applyInPandas(choose, "type long, class long").toArrow()
    out = classes.copy()
    out[got["type"].to_numpy()] = got["class"].to_numpy()
    return out


def likelihood(table: np.ndarray) -> float:
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def cluster(codes: DataFrame, types: Types, n_classes: int, rounds: int, more_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each type and counts of neighbouring classes."""
    counts = bigrams(codes, types.start, types.n_first)
    first = exchange(counts, n_classes, rounds)
    member = np.zeros((types.n_first, n_classes + 1))
    member[np.arange(types.n_first), first] = 1
    classes, table = first[types.start], member.T @ counts @ member
    for _ in range(more_rounds if types.total > types.n_first else 0):
        now = moved(codes, types, classes, table)
        then = bigrams(codes, now, n_classes + 1)
        if likelihood(then) <= likelihood(table):
            break
        classes, table = now, then
    return classes, table


class Model:
    """Types, classes and log10 probabilities; what a worker needs to score."""

    def __init__(self, types: Types, classes: np.ndarray, table: np.ndarray, by_type: dict[int, tuple[int, int]]):
        self.types, self.classes = types, classes
        size = len(table)
        self.step = np.log10((table + 1) / (table.sum(1, keepdims=True) + size))
        n, v = np.zeros(types.total), np.zeros(types.total)
        for t, (words, total) in by_type.items():
            v[t], n[t] = words, total
        self.n_all, self.v_all = int(n.sum()), int(v.sum())
        #: Of a type: log10 of 1 / (n(c) + v(c) + 1).
        self.spare = -np.log10(np.bincount(classes, n + v, size) + 1)[classes]
        self.spare[0] = -np.log10(n[0] + 1)  # the end's class holds nothing else
        self.base = -np.log10(self.n_all + self.v_all + 1)
        self.logs = np.log10(types.counts + 1)

    def score(self, words: list[bytes]) -> tuple[int, float, float, dict[bytes, int]]:
        """Known head tokens, base and model score but for log10(n + 1) of the tail, and the tail's words."""
        places, k = self.types.of(words)
        c = self.classes[k]
        head = places >= 0
        logs = float(self.logs[places[head]].sum())
        steps = float(self.step[np.concatenate([self.classes[:1], c[:-1]]), c].sum())
        known = int((self.types.counts[places[head]] > 0).sum())
        tail = Counter(words[i] for i in np.flatnonzero(~head))
        return known, len(words) * self.base + logs, steps + float(self.spare[k].sum()) + logs, tail


def fit(
    train: DataFrame, n_head: int, n_types: int, n_signatures: int, n_classes: int, rounds: int, n_least: int = 3, more_rounds: int = 3
) -> tuple[Model, DataFrame, int]:
    """A model, the table of all word counts, and the count from which a word is in the head."""
    counts = written(word_counts(train), "word-counts")
    limit = head_limit(counts, n_head)
    head = counts.where(F.col("n") >= limit).toArrow()
    types = Types(dict(zip(head["word"].to_pylist(), head["n"].to_pylist())), n_types, n_signatures, n_least)
    ending = F.substring("word", -3, 3)
    sign = (F.crc32(F.when(F.length("word") < 3, F.col("word")).otherwise(ending)) % n_signatures).cast("int")
    rows = counts.groupBy(sign.alias("s")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    left = {n_types + 1 + r.s: [r.words, r.n] for r in rows}
    by_type = {}
    for w, own, n in types.own():
        if n:
            t = _signature(w, n_types, n_signatures)
            left[t][0] -= 1
            left[t][1] -= n
            by_type[own] = (1, n)
    by_type |= {t: tuple(x) for t, x in left.items()}
    classes, table = cluster(encoded(train, types), types, n_classes, rounds, more_rounds)
    return Model(types, classes, table, by_type), counts, limit


def score(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_head: int = 200_000,
    n_types: int = 600,
    n_signatures: int = 256,
    n_classes: int = 48,
    rounds: int = 6,
    n_least: int = 3,
    more_rounds: int = 3,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("held_out", is_held_out(F.col("doc_id")))
    model, counts, limit = fit(docs.where("NOT held_out"), n_head, n_types, n_signatures, n_classes, rounds, n_least, more_rounds)
    held = df.sparkSession.sparkContext.broadcast(model)
    schema = "uid long, word binary, k int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for x in batches:
            for at in range(0, len(x), 1000):
                some = x.iloc[at : at + 1000]
                heads, uids, words, ks = [], [], [], []
                for uid, t in zip(some["uid"], some["text"]):
                    w = tokens(t)
                    known, base, mine, tail = own.score(w)
                    heads.append((END + int(uid).to_bytes(8, "big"), len(w), known, base, mine))
                    uids += [uid] * len(tail)
                    words += tail.keys()
                    ks += tail.values()
                one = pd.DataFrame(heads, columns=["word", "n_tokens", "n_known", "base", "own"])
                for c in ("uid", "doc_id", "held_out"):
                    one[c] = some[c].to_numpy()
                one["k"] = None
                two = pd.DataFrame({"uid": uids, "word": words, "k": ks})
                for c in ("doc_id", "held_out", "n_tokens", "n_known", "base", "own"):
                    two[c] = None
                yield one
                yield two

    # The key of a document's own row is no word, and differs from row to row, so it meets nothing in the join. Rows are written
    # before they are shuffled: a task that runs again then finds the same uid.
    rows = written(docs.withColumn("uid", F.monotonically_increasing_id()).mapInPandas(run, schema), "scored-heads")
    tail = counts.where(F.col("n") < limit).withColumnRenamed("n", "c")
    rows = rows.join(tail, "word", "left")
    logs = F.col("k") * F.coalesce(F.log10(F.col("c") + 1), F.lit(0.0))
    got = rows.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("k"))), F.lit(0))).alias("n_known"),
        F.lit(model.n_all).cast("long").alias("train_tokens"),
        (F.max("base") + F.coalesce(F.sum(logs), F.lit(0.0))).alias("base_score"),
        (F.max("own") + F.coalesce(F.sum(logs), F.lit(0.0))).alias("score"),
    )
    return got.drop("uid")
