"""N-gram Jaccard join by chosen paths, and near-duplicate classes.

A text is the set of its shingles: ``n`` words in a row (words lowered A-Z;
fewer words make one shingle of all). Texts with equal sets are one node, so
copies meet once, in a count.

Chosen paths. In each run a set samples each of its tokens with probability
1 / (threshold * size) by a hash all sets share, and goes to the bucket of each
token sampled. A pair at the threshold shares one such bucket or more, on
average. A bucket of at most ``small`` sets is compared whole. In a larger one
every set is compared with ``PIVOTS`` of them, and what all this links are the
first candidate groups. A large bucket of one group then ends; if half of its
sets or more are of one group, the others join that group, and it ends too. Else
its sets are split again by one or two tokens sampled anew, the smallest of hash
ranges that the path draws, and so on below. So a bucket of many copies ends
where it is found, and one of a passage that many texts share falls apart.
Buckets still large after ``DEPTH`` splits are compared whole, by blocks. Runs
are repeated until ``recall`` of the pairs at the threshold are expected to be
found, whatever the depth (``runs_for``).

Comparisons within buckets are of sketches (smallest token of each of 128 hash
ranges, one byte each); pairs that may reach the threshold link their nodes to
candidate groups. Within each group every pair is then compared exactly. Large
groups are cut to blocks, and each two blocks are compared by a task, so none is
gathered whole, and a task returns a row for each node, not for each pair. A
bitmap of ``2 ** filter_bits`` bits keeps most texts that no group needs out of
the shuffle; the join behind it is exact.

Shingles are compared by 64-bit hashes. Equal texts are always one class.

Cases: null and empty texts, and those of white space alone, are one class;
repeated rows and ids are rows of their own; very long texts are hashed whole;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written
from scriptorium.llm.components import components

DEPTH = 3
PIVOTS = 3
#: A bucket draws one range or, as often, two: unlike texts must meet less often from depth to depth.
BRANCHES = (1, 2)
BINS = 128
#: An odd base and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes; powers of the base are kept for texts up to some length."""

    def __init__(self, n: int):
        self.n = n
        self._grow(1 << 14)

    def _grow(self, size: int) -> None:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def tokens(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(b" ".join(words), np.uint8)
        if len(raw) > len(self.up):
            self._grow(2 * len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
        gaps = np.flatnonzero(raw == 32)
        first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        k = min(self.n, len(words)) - 1
        first, last = first[: len(first) - k], last[k:]
        h = (total[last] - total[first]) * self.down[first]
        return np.unique(_mix(h ^ (last - first).astype(np.uint64)))


def sketch(tokens: np.ndarray) -> bytes:
    """For each range of hashes a byte, 1 to 255, of its smallest token; 0 if it has none."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
    at = np.searchsorted(tokens, edges)
    inside = (at < len(tokens)) & (at < np.append(at[1:], len(tokens)))
    out = np.zeros(BINS, np.uint8)
    out[inside] = (tokens[at[inside]] & np.uint64(0xFFFFFF)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def runs_for(recall: float, threshold: float) -> int:
    """Runs that find a pair at the threshold with probability ``recall``, though all its buckets be split at every depth."""
    survives = 1.0
    for _ in range(DEPTH):  # a pair agrees in a range with a probability of the threshold
        survives = sum(1 - (1 - threshold * survives) ** k for k in BRANCHES) / len(BRANCHES)
    return math.ceil(-math.log(1 - recall) / survives)


def chosen(tokens: np.ndarray, runs: int, threshold: float) -> np.ndarray:
    """Keys of the buckets a set goes to: of each run, those of the tokens that it samples there."""
    rate = 1 / (threshold * max(len(tokens), 1))
    paths = (np.arange(runs, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)) | np.uint64(1)
    if rate >= 1:
        return _mix(tokens[:, None] ^ paths).ravel().view(np.int64)
    limit, out = np.uint64(min(rate * 2.0**64, 2.0**64 - 4096)), []
    for at in range(0, len(tokens), 1 << 16):
        some = tokens[at : at + (1 << 16), None]
        token, run = np.nonzero(some * paths < limit)  # tokens are mixed well, so one multiplication deals them anew
        out.append(_mix(some[token, 0] ^ paths[run]))
    return np.concatenate(out).view(np.int64)


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of one key each, of batches sorted by it."""
    rest: list[pd.DataFrame] = []
    for x in batches:
        if not len(x):
            continue
        k = x[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if rest and rest[0][key].iloc[0] != k[0]:
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        for a, b in zip([0, *cuts], [*cuts, len(x)]):
            part = x.iloc[a:b]
            if b < len(x):
                yield pd.concat([*rest, part]) if rest else part
                rest = []
            else:
                rest.append(part)
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, of a symmetric boolean matrix."""
    root = np.arange(len(linked))
    while True:
        parts = [np.where(linked[a : a + 256], root, len(root)).min(1) for a in range(0, len(root), 256)]
        new = np.minimum(np.concatenate(parts), root)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def in_blocks(df: DataFrame, key: str, node: str, n: Column, block: int) -> DataFrame:
    """df with a column ``task``: rows of a key with n rows meet in as many tasks as there are pairs of blocks."""
    blocks = F.ceil(n / block).cast("int")
    mine = F.pmod(F.xxhash64(node, F.lit(5)), blocks).cast("int")
    df = df.withColumns({"_blocks": blocks, "side": mine})
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("side", "_other"), F.greatest("side", "_other")
    df = df.withColumn("task", F.md5(F.concat_ws("/", F.col(key).cast("string"), low, high)))
    return df.drop("_blocks", "_other")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def node_table(df: DataFrame, n: int, threshold: float, runs: int) -> DataFrame:
    """A row for each document: doc_id, text_id, node (digest of its set), sketch, and its first buckets."""
    names = ["doc_id", "text_id", "node", "sketch", "buckets"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(n)
        for x in batches:
            for at in range(0, len(x), 500):
                rows, some = [], x.iloc[at : at + 500]
                for doc_id, text_id, text in zip(some["doc_id"], some["text_id"], some["text"]):
                    t = own.tokens(text)
                    node = hashlib.blake2b(t.tobytes(), digest_size=16).digest()
                    rows.append((doc_id, text_id, node, sketch(t), chosen(t, runs, threshold)))
                yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, "doc_id long, text_id string, node binary, sketch binary, buckets array<long>")


def alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sketches agree in ``least`` of the ranges that either has a token in; both have BINS columns."""
    same = ((a == b) & (a > 0)).sum(-1)
    return same >= least * ((a | b) > 0).sum(-1)


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BINS)


def links_within(rows: DataFrame, key: str, least: float) -> DataFrame:
    """Edges (a, b) between the alike of (key, node, sketch) that share a key, each to the smallest place it reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for x in groups(batches, key):
            m = len(x)
            if m < 2:
                continue
            s, nodes = _sketches(x["sketch"]), x["node"].to_numpy()
            if m == 2:
                if alike(s[0], s[1], least):
                    a.append(nodes[1:])
                    b.append(nodes[:1])
                continue
            near = np.zeros((m, m), bool)
            for i in range(m - 1):
                near[i, i + 1 :] = alike(s[i], s[i + 1 :], least)
            if near.any():
                root = _roots(near | near.T)
                some = np.flatnonzero(root != np.arange(m))
                a.append(nodes[some])
                b.append(nodes[root[some]])
                if len(a) >= 5000:
                    yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                    a, b = [], []
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return _dealt(rows.select(key, "node", "sketch"), key).mapInPandas(run, "a long, b long")


def links_to_pivots(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of (bucket, node, sketch, pivot) to the alike of its bucket's pivots, which are few; its rows may lie anywhere."""
    nodes, bytes_ = F.transform("p", lambda x: x.node), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x.sketch))
    pivots = rows.where("pivot").groupBy("bucket").agg(F.collect_list(F.struct("node", "sketch")).alias("p"))
    pivots = pivots.select("bucket", nodes.alias("nodes"), bytes_.alias("sketches"))
    met = rows.select("bucket", "node", "sketch").join(pivots, "bucket").select("node", "sketch", "nodes", "sketches")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 2000):
                some = x.iloc[at : at + 2000]
                k = some["nodes"].map(len).to_numpy()
                own, nodes = np.repeat(_sketches(some["sketch"]), k, axis=0), np.repeat(some["node"].to_numpy(), k)
                other = np.concatenate(some["nodes"].tolist())
                near = alike(own, _sketches(some["sketches"]), least) & (nodes != other)
                yield pd.DataFrame({"a": nodes[near], "b": other[near]})

    return met.mapInPandas(run, "a long, b long")


def children(rows: DataFrame) -> DataFrame:
    """(bucket, node, label, sketch) one depth below, by as many tokens as the bucket draws."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                bucket = x["bucket"].to_numpy().view(np.uint64)
                draws = np.array(BRANCHES)[_mix(bucket) % np.uint64(len(BRANCHES))]
                for i in range(max(BRANCHES)):
                    some = draws > i
                    path = _mix(bucket[some] ^ np.uint64(0xD1342543DE82EF95 * (i + 1) % (1 << 64)))
                    s = _sketches(x["sketch"][some])
                    turned = (np.arange(BINS) + (path % np.uint64(BINS)).astype(np.int64)[:, None]) % BINS
                    # The first range at or after the drawn one that the set has a token in.
                    at = turned[np.arange(len(s)), np.take_along_axis(s > 0, turned, 1).argmax(1)]
                    token = s[np.arange(len(s)), at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(8))
                    yield x[some].assign(bucket=_mix(path ^ _mix(token)).view(np.int64))

    return rows.select("bucket", "node", "label", "sketch").mapInPandas(run, "bucket long, node long, label long, sketch binary")


def judged(rows: DataFrame) -> DataFrame:
    """Rows of buckets of two groups or more, with n (rows of the bucket), others (of these not of its largest group), main (that group)."""
    sizes = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    most = F.max(F.struct("k", "label"))
    sizes = sizes.groupBy("bucket").agg(F.sum("k").alias("n"), (F.sum("k") - most.k).alias("others"), most.label.alias("main"))
    return rows.join(sizes.where("others > 0"), "bucket")


def candidate_groups(nodes: DataFrame, least: float, small: int, block: int) -> DataFrame:
    """(node, label) of the nodes (node, sketch, buckets) that are to be compared exactly, by group."""
    rows = nodes.select(F.explode("buckets").alias("bucket"), "node")
    drawn = [F.xxhash64("node", "bucket", F.lit(i)) for i in range(PIVOTS)]
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.min(h).alias(f"least{i}") for i, h in enumerate(drawn)]).where("n > 1")
    pivot = F.exists(F.array(*[h == F.col(f"least{i}") for i, h in enumerate(drawn)]), lambda x: x)
    found = rows.join(sizes, "bucket").select("bucket", "node", "n", pivot.alias("pivot"))
    found = written(found.join(nodes.select("node", "sketch"), "node"), "buckets")
    large = found.where(F.col("n") > small)
    edges = links_within(found.where(F.col("n") <= small), "bucket", least)
    if large.isEmpty():
        return components(edges)
    labels = components(edges.unionByName(links_to_pivots(large, least)))
    # Pivots have met all of their bucket.
    rows = large.where("NOT pivot").select("bucket", "node", "sketch").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    few, one = F.col("n") <= small, 2 * F.col("others") <= F.col("n")
    for depth in range(DEPTH + 1):
        left = written(judged(rows), "mixed")
        joins = left.where(~few & one & (F.col("label") != F.col("main")))
        edges = edges.unionByName(links_within(left.where(few), "bucket", least))
        edges = edges.unionByName(joins.select(F.col("label").alias("a"), F.col("main").alias("b")))
        left = left.where(~few & ~one)
        if left.isEmpty():
            break
        if depth < DEPTH:
            rows = written(children(left), "children")
        else:
            edges = edges.unionByName(links_within(in_blocks(left, "bucket", "node", F.col("n"), block), "task", least))
    return components(edges)


def perhaps_in(keys: DataFrame, bits: int):
    """A function of a 64-bit hash column: false only for hashes that ``keys`` (column ``h``) lacks.

    A bitmap of 2 ** bits bits, whatever the number of keys, and two bits a key; with far more keys than bits all hashes pass.
    """
    places = F.array(*[F.shiftrightunsigned("h", i * bits).bitwiseAND((1 << bits) - 1) for i in range(2)])
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = keys.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("word"))
    bitmap = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    for at, word in words.collect():
        bitmap[at] = word % (1 << 64)
    held = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def run(h: pd.Series) -> pd.Series:
        own, h, found = held.value, h.to_numpy().view(np.uint64), True
        for i in range(2):
            place = (h >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)
            found &= own[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0
        return pd.Series(found)

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets."""
    m, sizes = len(sets), [len(s) for s in sets]
    token, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    opens = np.concatenate([[True], token[1:] != token[:-1]])
    starts = np.flatnonzero(opens)
    lengths = np.diff(np.append(starts, len(token)))
    run = np.cumsum(opens) - 1
    shared = lengths > 1
    mine = [[] for _ in range(m)]
    keep = np.flatnonzero(shared[run])
    by_owner = keep[np.argsort(owner[keep], kind="stable")]
    cuts = np.searchsorted(owner[by_owner], np.arange(m + 1))
    out = np.zeros((m, m), np.int64)
    for i in range(m):
        mine = run[by_owner[cuts[i] : cuts[i + 1]]]
        n = lengths[mine]
        at = np.repeat(starts[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[i] = np.bincount(owner[at], minlength=m)
    np.fill_diagonal(out, sizes)
    return out


def exact_links(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """Of (node, label, n, copies, tokens): node, root (linked to it), links (rows it is linked to)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in groups(batches, "task"):
            x = x.drop_duplicates("node")
            m = len(x)
            if m < 2:
                continue
            sets = [np.frombuffer(t, np.uint64) for t in x["tokens"]]
            size = np.array([len(s) for s in sets])
            both = _overlaps(sets)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            side = x["side"].to_numpy()
            if side.min() != side.max():  # pairs within a block are the task of that block alone
                linked &= side[:, None] != side[None, :]
            if not linked.any():
                continue
            root, nodes = _roots(linked), x["node"].to_numpy()
            some = np.flatnonzero(linked.any(1))
            links = linked[some] @ x["copies"].to_numpy()
            yield pd.DataFrame({"node": nodes[some], "root": nodes[root[some]], "links": links})

    rows = in_blocks(rows, "label", "node", F.col("n"), block)
    return _dealt(rows.select("task", "node", "side", "copies", "tokens"), "task").mapInPandas(run, "node long, root long, links long")


def near_duplicates(
    df: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    small: int = 64,
    slack: float = 0.2,
    sketch_block: int = 2048,
    block: int = 512,
    filter_bits: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its near-duplicate class), copy_id (of its equal sets), n_links.

    Also text_id (digest of the text) and stays: whether a row is of its class's first id and, with it, first text.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("text_id", F.md5(F.coalesce("text", F.lit(""))))
    rows = written(node_table(docs, n, threshold, runs_for(recall, threshold)), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")).alias("rep")
    same = [F.first(c).alias(c) for c in ("sketch", "buckets")]
    nodes = rows.groupBy(F.col("node").alias("digest")).agg(first, F.count(F.lit(1)).alias("copies"), *same)
    # The number that stands for a set from here on; it is drawn once, as the table is written.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = candidate_groups(nodes.select("node", "sketch", "buckets"), threshold - slack, small, sketch_block)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = written(labels.join(sizes, "label").join(nodes.select("node", "rep", "copies"), "node"), "labels")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(n)
        for x in batches:
            for at in range(0, len(x), 500):
                some = x.iloc[at : at + 500]
                out = some[["node", "label", "n", "copies"]].copy()
                out["tokens"] = [own.tokens(t).tobytes() for t in some["text"]]
                yield out

    wanted = labels.select("node", "label", "n", "copies", F.col("rep.doc_id").alias("d"), F.col("rep.text_id").alias("text_id"))
    key = F.xxhash64(F.col("doc_id"), F.col("text_id"))
    perhaps = perhaps_in(labels.select(F.xxhash64("rep.doc_id", "rep.text_id").alias("h")), filter_bits)
    docs = docs.where(perhaps(key))  # so that only texts to be compared are shuffled
    texts = docs.join(wanted, (docs.text_id == wanted.text_id) & docs.doc_id.eqNullSafe(wanted.d))
    texts = texts.select("node", "label", "n", "copies", "text")
    sets = texts.mapInPandas(tokens, "node long, label long, n long, copies long, tokens binary")
    links = written(exact_links(sets, threshold, block), "links")
    final = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = final.join(counts, "node", "left").join(nodes.select("node", "rep"), "node")
    classes = known.groupBy("label").agg(F.min("rep").alias("first"))
    known = known.join(classes, "label").select("node", "first", "links")
    out = nodes.select("node", "digest", "rep", "copies").join(known, "node", "left").withColumn("first", F.coalesce("first", "rep"))
    out = rows.select("doc_id", "text_id", F.col("node").alias("digest")).join(out, "digest")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    return out.select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        F.col("rep.doc_id").alias("copy_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        "text_id",
        own.alias("stays"),
    )


def keep_one(df: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of df of each near-duplicate class."""
    found = near_duplicates(df, n, threshold).where("stays").select("doc_id", "text_id").distinct()
    key = F.concat_ws("/", F.col("doc_id").cast("long").cast("string"), "text_id")  # a null id gives no slash
    rows = df.select(F.struct(*df.columns).alias("whole"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_id"))
    rows = rows.select("whole", key.alias("key")).join(found.select(key.alias("key")), "key", "left_semi")
    return rows.dropDuplicates(["key"]).select("whole.*")
