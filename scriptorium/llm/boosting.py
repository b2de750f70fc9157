"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text gives some thirty statistics: shares of kinds of characters and
words, lengths, repetition of words, word triples and lines, entropy, and how
well the text compresses. Their values are cut into at most ``bins`` quantile
bins; trees of fixed depth are grown level by level from histograms of gradients
and second derivatives of the logistic loss. The trees are flattened into three
arrays (statistic and threshold of each inner node, value of each leaf), and all
rows of a batch walk all trees at once by indexing.

The model is fitted on the driver on a bounded sample: at most ``max_rows``
labelled rows, taken by hash of their id. All rows are then scored, in one scan,
by their text alone.

Cases: a null text is an empty one, and has a score too; labels other than 0 and
1, null ids, and ids with both labels are not learned from; an id with several
rows is learned from each; with labels of one kind or none the score of every
text is the smoothed share of label 1 (0.5 without labels); texts of any length
are read whole; repeated rows get equal scores; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of a batch that are Python strings at one time.
SOME = 500
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".!?",
    "pause": b",;:",
    "quote": b"'\"()",
    "symbol": b"#*$%&|<>",
    "other": b"+-/=@[\\]^_`{}~",
    "vowel": b"aeiouAEIOU",
    "control": bytes(range(9)) + bytes(range(14, 32)) + b"\x7f",
    "beyond": bytes(range(128, 256)),
}
_TABLE = np.array([[b in kind for kind in _KINDS.values()] for b in range(256)], float)
STATISTICS = [
    "chars words lines word_chars longest distinct_words top_word repeated_triples repeated_lines line_words short_lines "
    "capital_words upper_words symbol_words stop_words bare_words entropy compressed",
    *_KINDS,
]
STATISTICS = STATISTICS[0].split() + STATISTICS[1:]
_ENDS = tuple(".!?")


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    shares = counts[counts > 0] / n
    words = text.split()
    k = max(len(words), 1)
    held = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    m = max(len(lines), 1)
    triples = len(words) - 2
    symbols = set("#*$%&|<>")
    letters = set(map(len, held))
    out = [
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        sum(len(w) * c for w, c in held.items()) / k,
        np.log1p(max(letters, default=0)),
        len(held) / k,
        max(held.values(), default=0) / k,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 0.0,
        1 - len(set(lines)) / m if lines else 0.0,
        np.log1p(len(words) / m),
        sum(len(line) < 30 for line in lines) / m,
        sum(c for w, c in held.items() if w[0].isupper()) / k,
        sum(c for w, c in held.items() if len(w) > 1 and w.isupper()) / k,
        sum(c for w, c in held.items() if not symbols.isdisjoint(w)) / k,
        sum(c for w, c in held.items() if w.endswith(_ENDS)) / k,
        sum(c for w, c in held.items() if w.isalpha()) / k,
        float(-(shares * np.log2(shares)).sum()),
        len(zlib.compress(raw, 1)) / n,
    ]
    return out + (counts @ _TABLE / n).tolist()


class Trees:
    """Boosted trees of one depth, flattened: inner nodes by level, then leaves."""

    def __init__(self, start: float, depth: int, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.start, self.depth, self.feature, self.threshold, self.leaf = start, depth, feature, threshold, leaf

    def margins(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), np.arange(len(self.leaf))[None, :]
        rows, at = np.arange(n)[:, None], np.zeros((n, len(self.leaf)), np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        return self.start + self.leaf[trees, at - self.feature.shape[1]].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Between-bin thresholds of each column: midpoints at distinct quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[:-1] + values[1:]) / 2
        out.append(middle if len(middle) < bins else np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def grow(
    x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 2.0, ridge: float = 1.0
) -> Trees:
    """Boosted trees for labels of 0 and 1; ``least`` is the second-derivative sum that each side of a split needs."""
    n, d = x.shape
    cuts = cut_points(x, bins)
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    inner = (1 << depth) - 1
    start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    margin = np.full(n, start)
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    spread = binned + np.arange(d) * bins  # place of each value in a node's histogram
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            place = (spread + (at - first)[:, None] * (d * bins)).ravel()
            shape = nodes, d, bins
            sums = [np.bincount(place, np.repeat(v, d), nodes * d * bins).reshape(shape).cumsum(2) for v in (g, h)]
            gl, hl = sums
            ga, ha = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (ha - hl < least)] = -1.0
            for k in range(nodes):
                f, b = divmod(int(gain[k].argmax()), bins)
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            right = x[np.arange(n), feature[t, at]] > threshold[t, at]
            at = 2 * at + 1 + right
        g, h = (np.bincount(at - inner, v, inner + 1) for v in (g, h))
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t, at - inner]
    return Trees(start, depth, feature, threshold, leaf)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Trees of (doc_id, text) and (doc_id, label), from at most ``max_rows`` rows."""
    one = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_b"))
    one = one.where("label = _b").select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), SOME):
                some = b.slice(at, SOME)
                rows = [np.array(statistics(t)).tobytes() for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(rows, pa.binary())], names=["h", "label", "v"])

    # At most max_rows rows of three numbers.
    drawn = docs.join(F.broadcast(one), "doc_id").select("h", F.col("label").cast("int").alias("label"), "text")
    rows = drawn.mapInArrow(run, "h long, label int, v binary").orderBy("h", "v").limit(max_rows).collect()
    if not rows:
        return Trees(0.0, 0, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)))
    x = np.stack([np.frombuffer(r.v) for r in rows])
    y = np.array([r.label for r in rows], float)
    return grow(x, y, trees=120 if 0 < y.sum() < len(y) else 0)


def classify(df: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each text, learned from the labels (doc_id, quality) of those not held out."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    trees = fit(docs, known.where(~is_held_out(F.col("doc_id"))), max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), SOME):
                some = b.slice(at, SOME)
                x = np.array([statistics(t) for t in some.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(trees.scores(x), pa.float64())], names=["doc_id", "score"])

    got = docs.mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
