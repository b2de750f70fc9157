"""Alignment of two tokenizers' ids by a string of byte labels.

A text, with one space put before it, is encoded by tokenizer A (byte-level BPE)
and by tokenizer B (sentencepiece with byte fallback, which adds that space
itself). Every byte of the text gets a label: ``.`` if no token ends after it,
``a`` or ``b`` if one of that tokenizer ends there, ``x`` if both do. A regular
expression scans the labels for spans up to each ``x``; a span is a group, and
its labels count how many tokens of each side the group takes.

Both tokenizers always end a token before a space that stands between two
characters that are no white space (checked for their vocabularies when they are
read), so texts are cut there and each different piece is encoded and scanned
once per worker while it is remembered, as four bytes for each token. A text
whose pieces do not give back its bytes is encoded whole, and has no tokens if
that does not give them back either.

All A-B pairs of a group are links. An id pair's count is the number of texts
that hold it linked. Counting is an aggregate of pairs with partial sums; counts
go back to the texts by a broadcast of the most frequent pairs, at most
``1 / HOT`` of them as no more can have that share of all rows each, and by a
join for the rest, of which none has more than that share of the rows.

Cases: null and empty texts, and those that a tokenizer does not give back byte
by byte (for example with U+2581), have no tokens: zeros and an empty listing;
texts of any length are aligned whole; repeated rows, and rows with a null or
equal id, are each their own row and each count as a text; columns other than
the two named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import worker_cache, written

#: Pieces that a worker remembers in each of two generations, and the longest of them.
REMEMBERED, SHORT = 250_000, 64
#: Pieces of a text whose listing and links are made at one time.
STRETCH = 20_000
#: Texts, and characters of their listings, that go to Spark at one time.
SOME, MUCH = 400, 8_000_000
#: A pair that has this share of all rows, or more, is looked up in a broadcast table.
HOT = 1e-5
#: A space between two characters that no pattern takes for white space.
_CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")
#: At the outer end of a text's first or last piece, so that no other may stand there.
_OUTER = re.compile(r"[\s\u180e]")
_OVER = re.compile(r"[^\s\u180e] ")
_LABELS = bytes.maketrans(b"\x00\x01\x02\x03", b".abx")
_GROUP = re.compile(rb"[^x]*x")

SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "links array<struct<a:int,b:int,n:long>>"
)


def labels(ends_a: np.ndarray, ends_b: np.ndarray, n_bytes: int) -> bytes:
    """One of ``.abx`` for each byte: which tokenizer's tokens end with it."""
    out = np.zeros(n_bytes, np.uint8)
    out[ends_a - 1] |= 1
    out[ends_b - 1] |= 2
    return out.tobytes().translate(_LABELS)


def signs_to_bytes() -> dict[str, int]:
    """Byte-level sign of each byte, by rule: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligned:
    """A stretch of a text: listing of its groups, counts, and its links, each as eight bytes."""

    __slots__ = ("listing", "n_a", "n_b", "n_groups", "pairs")

    def __init__(self, listing: str, n_a: int, n_b: int, n_groups: int, pairs: bytes):
        self.listing, self.n_a, self.n_b, self.n_groups, self.pairs = listing, n_a, n_b, n_groups, pairs


class Sizes(dict):
    """Number of A and of B tokens of a group by its span of labels."""

    def __missing__(self, span: bytes) -> tuple[int, int]:
        got = span.count(b"a") + 1, span.count(b"b") + 1
        if len(span) < 40:
            self[span] = got
        return got


class Aligner:
    """Aligns texts; remembers short pieces."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = signs_to_bytes()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            known = all(c in byte_of for c in token)
            self.bytes_a[k] = bytes(byte_of[c] for c in token) if known else token.encode()
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)
        ]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        #: Whether no entry goes on over a space that follows a sign, as cutting takes for granted.
        entries = [x.decode("utf-8", "replace") for x in self.bytes_a + self.bytes_b]
        self.cuts = not any(_OVER.search(x) for x in entries)
        self.sizes = Sizes()
        #: Each id as it stands in a listing: of A within and at the end of its side of a group, then of B.
        names_a, names_b = map(str, range(len(self.bytes_a))), map(str, range(len(self.bytes_b)))
        sides = [(x + ",", x + "|") for x in names_a] + [(x + ",", x + ";") for x in names_b]
        self.signs = np.array(list(itertools.chain.from_iterable(sides)), object)
        #: Of each piece its tokens in the order of a listing, as indexes of ``signs``; none for one that does not give back its bytes.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Each piece with a space before it; empty for one that does not give back its bytes. Several must be parted by cuts."""
        text = " ".join(pieces)
        ids_a, ids_b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        raw = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            half = len(pieces) // 2
            return self._encode(pieces[:half]) + self._encode(pieces[half:]) if half else [b""]
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        line = labels(self.len_a[ids_a].cumsum(), self.len_b[ids_b].cumsum(), len(raw))
        spans = _GROUP.findall(line)
        sizes = np.fromiter(itertools.chain.from_iterable(map(self.sizes.__getitem__, spans)), np.int64, 2 * len(spans))
        p, q = sizes[0::2], sizes[1::2]
        end_a, end_b = p.cumsum(), q.cumsum()
        # The listing: of each group its tokens of A, then those of B.
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[end_a - 1] = last_b[end_b - 1] = 1
        is_b = np.repeat(np.tile(np.array([False, True]), len(spans)), sizes)
        codes = np.empty(len(is_b), np.int32)
        codes[~is_b], codes[is_b] = 2 * ids_a + last_a, 2 * (len(self.bytes_a) + ids_b) + last_b
        # A piece ends with a group.
        ends = np.fromiter((len(x.encode()) + 1 for x in pieces), np.int64, len(pieces)).cumsum()
        group = np.searchsorted(np.fromiter(map(len, spans), np.int64, len(spans)).cumsum(), ends)
        held, past = codes.tobytes(), (codes.itemsize * (end_a + end_b)[group]).tolist()
        return [held[i:j] for i, j in zip([0, *past], past)]

    def _learn(self, new: set[str], outer: tuple[str, str]) -> dict[str, bytes]:
        """The new pieces of a text by name; short ones are remembered. Of all, only the outer ones may begin or end with white space."""
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.before = {}, self.known
        got = {p: self.before[p] for p in new & self.before.keys()}
        alone = {p for p in outer if p in new and p not in got and (_OUTER.match(p) or _OUTER.match(p[-1:]))}
        joined = [p for p in new if p not in got and p not in alone]
        if joined:
            got.update(zip(joined, self._encode(joined)))
        got.update((p, self._encode([p])[0]) for p in alone)
        self.known.update((p, v) for p, v in got.items() if len(p) <= SHORT)
        return got

    def _aligned(self, pieces: list[bytes]) -> Aligned:
        """Listing and links of pieces that follow each other."""
        codes = np.frombuffer(b"".join(pieces), np.int32)
        is_b = codes >= 2 * len(self.bytes_a)
        a, b = codes[~is_b], codes[is_b]
        end_a, end_b = np.flatnonzero(a & 1) + 1, np.flatnonzero(b & 1) + 1
        p, q = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        # Each token of A as often as its group has tokens of B, with these in turn.
        times = np.repeat(q, p)
        past = times.cumsum()
        turn = np.arange(past[-1]) + np.repeat(np.repeat(end_b - q, p) - past + times, times)
        links = np.repeat(a.astype(np.int64) >> 1 << 32, times) | (b.astype(np.int64)[turn] >> 1) - len(self.bytes_a)
        return Aligned("".join(self.signs[codes].tolist())[:-1], len(a), len(b), len(p), links.tobytes())

    def align(self, text: str | None) -> list[Aligned] | None:
        """The text's stretches in order; None if it has no tokens."""
        if not text:
            return None
        parts = _CUT.split(text) if self.cuts else [text]
        got = list(map(self.known.get, parts))
        new = {p for p, v in zip(parts, got) if v is None}
        if new:
            more = self._learn(new, (parts[0], parts[-1]))
            got = [more[p] if v is None else v for p, v in zip(parts, got)]
        if not all(got):
            got = self._encode([text]) if len(parts) > 1 else [b""]
        return [self._aligned(got[i : i + STRETCH]) for i in range(0, len(got), STRETCH)] if all(got) else None


def _row(doc_id: int | None, got: list[Aligned] | None) -> tuple:
    if got is None:
        return doc_id, 0, 0, 0, 0, "", ()
    numbers = (sum(getattr(x, k) for x in got) for k in ("n_a", "n_b", "n_groups"))
    links = np.frombuffer(b"".join([x.pairs for x in got]), np.int64)
    keys, counts = np.unique(links, return_counts=True)
    return doc_id, *numbers, len(links), ";".join([x.listing for x in got]), (keys, counts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, *numbers, listing, links = zip(*rows)
    sizes = [len(x[0]) if x else 0 for x in links]
    keys = np.concatenate([x[0] for x in links if x] or [np.zeros(0, np.int64)])
    counts = np.concatenate([x[1] for x in links if x] or [np.zeros(0, np.int64)])
    fields = [("a", keys >> 32, pa.int32()), ("b", keys & 0xFFFFFFFF, pa.int32()), ("n", counts, pa.int64())]
    struct = pa.StructArray.from_arrays([pa.array(v.astype(t.to_pandas_dtype()), t) for _, v, t in fields], names=[f[0] for f in fields])
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())
    columns = [pa.array(ids, pa.int64()), *[pa.array(x, pa.int64()) for x in numbers], pa.array(listing, pa.string())]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(at, struct)], names=names)


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), links (a, b, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, key = worker_cache(), ("aligner", path_a, path_b)
        own = cache.get(key) or cache.setdefault(key, Aligner(path_a, path_b))
        for x in batches:
            rows, much = [], 0
            for at in range(0, len(x), SOME):
                some = x.slice(at, SOME).to_pydict()
                for doc_id, text in zip(some["doc_id"], some["text"]):
                    rows.append(_row(doc_id, own.align(text)))
                    much += len(rows[-1][5])
                    if len(rows) >= SOME or much > MUCH:
                        yield _batch(rows)
                        rows, much = [], 0
            if rows:
                yield _batch(rows)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n_docs, best: in how many texts each id pair is linked, and whether no pair of that A id is in more."""
    counts = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = written(counts, "pair-counts")
    # At most one row for each id of A's vocabulary.
    most = F.broadcast(counts.groupBy("a").agg(F.max("n_docs").alias("most")))
    return counts.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def link_statistics(aligned: DataFrame) -> DataFrame:
    """The columns of ``aligned`` but its links, with n_best and count_sum; ``aligned`` has links and any others."""
    kept = [c for c in aligned.columns if c != "links"]
    row = F.struct(*kept).alias("row")
    at = written(aligned.select(row, "links", F.monotonically_increasing_id().alias("uid")), "aligned")
    counts = pair_counts(at)
    total = counts.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") >= max(1.0, HOT * total)
    common = F.broadcast(counts.where(hot))  # at most 1 / HOT rows
    one = at.select("uid", F.inline("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum")]
    few = one.join(common.select("a", "b"), ["a", "b"], "left_anti").join(counts.where(~hot), ["a", "b"])
    both = one.join(common, ["a", "b"]).groupBy("uid").agg(*sums).unionByName(few.groupBy("uid").agg(*sums))
    both = both.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    got = at.select("uid", "row").join(both, "uid", "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return got.select("row.*", *zero)
