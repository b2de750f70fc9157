"""Packing by cutting-stock column generation.

Every document becomes token ids and an end id. Pieces of full sequence length
are cut off; what is left of each document is one shorter piece. Piece lengths,
in units of ``unit`` tokens rounded up, form a histogram of at most
``max_len / unit`` classes. A linear program over patterns (how many pieces of
each class share a sequence) is solved by column generation: the basis starts
with one pattern per class, duals price the classes, and a knapsack dynamic
program finds the pattern that enters, until the bound of the duals is within
``gap`` of the program. The patterns are rounded down; the few sequences that
this leaves open are filled greedily, largest class first. Pieces are ranked
within their class, and rank decides pattern, sequence and place.

Only the histogram reaches the driver: at most ``max_len / unit`` rows. Ranks
are counted in ``SALTS`` shares of each class, so no class meets in one task.

Tokens are those of the whole text. No token crosses a space or line break, so
text is cut there and each different piece is encoded once per task while it is
remembered; ids are kept as bytes.

Cases: a null or empty text is its end id alone; documents of any length are
cut; repeated rows and ids are packed one by one; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import worker_cache, written

SALTS = 64
#: Text pieces whose ids a worker remembers in each of two generations: some 35 MB each.
REMEMBERED = 150_000
#: Texts of an Arrow batch that are Python strings at one time.
SOME = 500
#: Letters of ASCII and Latin-1, then signs: tokenizers that part letters from signs encode the two alone.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
_LATIN = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]


class Encoder:
    """Texts to little-endian 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.ids = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        by_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        #: Latin-1 letters as the byte signs that the model's vocabulary is written in.
        self.signs_of = {ord(c): by_bytes.pre_tokenize_str(c)[0][0] for c in _LATIN}
        probe = ["Ab", "ab.,", "\u00c9t\u00e9\u00df", "\u00fcber\u00f1o;)", *_LATIN]
        #: Whether letters are lowered and parted from signs, as _PLAIN takes for granted.
        self.parts = all(self._plain(*_PLAIN.fullmatch(x).groups()) == self._whole([x])[0] for x in probe)
        self.known.clear()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            parts = text.replace("\n", " ").split(" ")
            try:
                yield b"".join(map(self.known.__getitem__, parts))
            except KeyError:
                self._learn(parts)
                yield b"".join(map(self.known.__getitem__, parts))

    def _learn(self, parts: list[str]) -> None:
        new = set(parts).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.before = {}, self.known
            new = set(parts)
        known, before, odd, plain = self.known, self.before, [], _PLAIN.fullmatch
        for part in new:
            if part in before:
                known[part] = before[part]
            elif self.parts and (m := plain(part)):
                known[part] = self._plain(m[1], m[2])
            else:
                odd.append(part)
        if odd:
            known.update(zip(odd, self._whole(odd)))

    def _whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def _plain(self, word: str, signs: str) -> bytes:
        word = word.lower()
        out = self._run(word if word.isascii() else word.translate(self.signs_of))
        if signs:
            if signs not in self.known:
                self.known[signs] = self._run(signs)
            out += self.known[signs]
        return out

    def _run(self, token: str) -> bytes:
        """Ids of one run of lower-case letters or of signs."""
        return b"".join([self.ids[t.id] for t in self.tokenize(token)])


def pieces(
    df: DataFrame, tokenizer: str, max_len: int, end_id: int, keep_ids: bool, id_col: str, text_col: str
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        own = cache.get(("encoder", tokenizer)) or cache.setdefault(("encoder", tokenizer), Encoder(tokenizer))
        out = pa.schema([(c, pa.int64()) for c in names] + [("ids", pa.list_(pa.int64()))] * keep_ids)
        try:
            for x in batches:
                for at in range(0, len(x), SOME):
                    some, rows = x.slice(at, SOME).to_pydict(), []
                    for doc_id, ids in zip(some["doc_id"], own.encode([t or "" for t in some["text"]])):
                        ids += end
                        n = len(ids) // 4
                        for a in range(0, n, max_len):
                            part = ids[4 * a : 4 * (a + max_len)]
                            row = (doc_id, a, len(part) // 4, zlib.crc32(part), n)
                            rows.append((*row, np.frombuffer(part, "<u4").tolist()) if keep_ids else row)
                    columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
        finally:
            # Spark keeps workers and gives them tasks in turn; what idle ones remember would add up.
            own.known, own.before = {}, {}

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, schema)


def best_pattern(value: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of most value; value[u] is that of a piece of u units, value[0] unused."""
    best, took = np.zeros(units + 1), np.zeros(units + 1, int)
    for c in range(1, units + 1):
        sums = value[1 : c + 1] + best[c - 1 :: -1] if c > 1 else value[1:2] + best[:1]
        u = int(sums.argmax())
        if sums[u] > best[c - 1]:
            best[c], took[c] = sums[u], u + 1
        else:
            best[c], took[c] = best[c - 1], 0
    pattern, c = np.zeros(units + 1, int), units
    while c > 0:
        pattern[took[c]] += took[c] > 0
        c -= max(int(took[c]), 1)
    return float(best[units]), pattern


def column_generation(demand: np.ndarray, gap: float = 1e-3, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that use up demand[u] pieces of u units in sequences of len(demand) - 1 units."""
    units = len(demand) - 1
    present = np.flatnonzero(demand)
    left = demand.astype(int).copy()
    plan: list[tuple[np.ndarray, int]] = []
    if len(present):
        m, d = len(present), demand[present].astype(float)
        each = units // present
        inverse, x = np.diag(1.0 / each), d / each
        columns = np.diag(each)
        for _ in range(rounds):
            duals = inverse.sum(axis=0)
            value = np.full(units + 1, -1.0)
            value[present] = duals
            worth, pattern = best_pattern(value, units)
            if worth <= 1 + 1e-9 or duals @ d / worth >= (1 - gap) * x.sum():
                break
            entering = pattern[present]
            step = inverse @ entering
            up = step > 1e-9
            ratios = np.where(up, x / np.where(up, step, 1.0), np.inf)
            k = int(ratios.argmin())
            x = np.maximum(x - ratios[k] * step, 0.0)
            x[k] = ratios[k]
            row = inverse[k] / step[k]
            inverse -= np.outer(step, row)
            inverse[k] = row
            columns[:, k] = entering
        for k in range(m):
            pattern = np.zeros(units + 1, int)
            pattern[present] = columns[:, k]
            used = pattern[present] > 0
            times = min(int(x[k] + 1e-6), int((left[present][used] // pattern[present][used]).min(initial=0)))
            if times > 0:
                plan.append((pattern, times))
                left -= pattern * times
    while left.any():
        pattern, room = np.zeros(units + 1, int), units
        for u in np.flatnonzero(left)[::-1]:
            n = min(int(left[u]), room // int(u))
            pattern[u], room = n, room - n * int(u)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


class Slots:
    """Where the pieces of each class go, by rank."""

    def __init__(self, plan: list[tuple[np.ndarray, int]]):
        held: dict[int, list] = {}
        sequence = 0
        for pattern, times in plan:
            for u in np.flatnonzero(pattern):
                held.setdefault(int(u), []).append((int(pattern[u]) * times, sequence, int(pattern[u])))
            sequence += times
        self.of = {}
        for u, rows in held.items():
            n, first, each = map(np.array, zip(*rows))
            self.of[u] = np.concatenate([[0], np.cumsum(n)[:-1]]), first, each

    def place(self, u: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, place = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        for k in np.unique(u):
            own = np.flatnonzero(u == k)
            start, first, each = self.of[int(k)]
            j = np.searchsorted(start, rank[own], "right") - 1
            within = rank[own] - start[j]
            sequence[own], place[own] = first[j] + within // each[j], within % each[j]
        return sequence, place


def pack(
    df: DataFrame,
    tokenizer: str,
    max_len: int = 4096,
    end_id: int = 2,
    unit: int = 8,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    got = pieces(df, tokenizer, max_len, end_id, keep_ids, id_col, text_col)
    units = F.ceil(F.col("length") / unit).cast("int")
    got = got.withColumns({"u": units, "uid": F.monotonically_increasing_id()})
    got = written(got.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")), "pieces")
    counts = got.groupBy("u", "salt").count()
    demand = np.zeros(-(-max_len // unit) + 1, int)
    for r in counts.groupBy("u").agg(F.sum("count").alias("n")).collect():
        demand[r.u] = r.n
    slots = Slots(column_generation(demand))
    before = F.sum("count").over(Window.partitionBy("u").orderBy("salt")) - F.col("count")
    # At most SALTS rows for each of the max_len / unit classes.
    counts = F.broadcast(counts.select("u", "salt", before.alias("before")))
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("u", "salt").orderBy("uid")) - 1)
    ranked = ranked.join(counts, ["u", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("sequence_id long, place long")
    def put(u: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, place = slots.place(u.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "place": place})

    placed = ranked.withColumn("at", put("u", "rank")).withColumns({"sequence_id": F.col("at.sequence_id"), "place": F.col("at.place")})
    order = Window.partitionBy("sequence_id").orderBy(F.desc("u"), "place")
    placed = placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return placed.select(*names)
