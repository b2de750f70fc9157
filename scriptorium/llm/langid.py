"""Language ID in two steps: language family, then one-versus-one linear SVMs within it.

A text is a vector of hashed byte 1-, 2- and 3-gram frequencies (square roots,
unit length) of the whole lower-cased text. Linear support vector machines
(squared hinge, dual coordinate descent) are fitted between each two families,
and between each two languages of one family. Languages that no list names a
family for are grouped by similarity: halved along the main direction of their
mean vectors until a group has at most ``max(8, sqrt(n))`` of n, so n languages
need some n * sqrt(n) machines, not n * n / 2. A text gets the family, then the
language, that wins most of these duels, ties going to the larger sum of
margins. The score multiplies, over both steps, the logistic of the winner's
smallest margin.

The model is fitted on the driver on a bounded sample of labelled rows:
``max_rows`` vectors, shared evenly among all languages: of each, the first texts
by hash of id and text, and one at least, so with more languages than
``max_rows`` it is one vector a language. Every row is then predicted, by text
alone.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is any
text if nothing could be learned; repeated rows get equal results; very long
texts are counted whole, a piece at a time; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import written

UND = "und"
SALTS = 16
#: Families of languages by code; others are grouped by similarity.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur pa mr gu ne si",
    "cjk": "zh ja ko",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_ASCII_LETTER = re.compile("[A-Za-z]")
_PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def vector(text: str, dims: int) -> np.ndarray:
    """Hashed byte n-gram frequencies of the whole text; the last entry is a constant for the offset."""
    counts = np.zeros(dims + 1, np.float32)
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    shift = np.uint32(32 - dims.bit_length() + 1)
    for at in range(0, len(raw), _PIECE):
        a = raw[max(0, at - 2) : at + _PIECE].astype(np.uint32)
        new = min(at, 2)  # bytes that the piece before has already counted alone
        two = a[:-1] << np.uint32(8) | a[1:] | np.uint32(1 << 24)
        three = two[:-1] << np.uint32(8) | a[2:]
        keys = np.concatenate([a[new:], two[max(0, new - 1) :], three])
        counts[:-1] += np.bincount(keys * np.uint32(2654435761) >> shift, minlength=dims)
    counts[:-1] = np.sqrt(counts[:-1])
    counts[:-1] /= max(float(np.linalg.norm(counts[:-1])), 1e-9)
    counts[-1] = 1.0
    return counts


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss; y is +1 or -1."""
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    inner = np.einsum("ij,ij->i", x, x) + 0.5 / c
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * float(w @ x[i]) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - g / inner[i], 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class Duels:
    """A linear machine for each two of some classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        machines = []
        for a, b in self.pairs:
            rows = np.flatnonzero((y == self.classes[a]) | (y == self.classes[b]))
            machines.append(fit_svm(x[rows], np.where(y[rows] == self.classes[a], 1.0, -1.0)))
        self.weights = np.stack(machines, axis=1) if machines else np.zeros((x.shape[1], 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner of each row and the logistic of its smallest margin."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        margins = x @ self.weights
        wins, total, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for j, (a, b) in enumerate(self.pairs):
            for side, m in ((a, margins[:, j]), (b, -margins[:, j])):
                wins[:, side] += m > 0
                total[:, side] += m
                least[:, side] = np.minimum(least[:, side], m)
        best = np.lexsort((total, wins), axis=1)[:, -1]
        return best, 1 / (1 + np.exp(-4 * least[np.arange(n), best]))


#: Languages that one group holds at least before it is halved.
GROUP = 8


def similar_groups(means: np.ndarray, names: list[str]) -> dict[str, str]:
    """Group of each name (means has a row for each); a group is called after its first name. Ties go by name."""
    most, left, out = max(GROUP, int(np.sqrt(len(names)))), [np.arange(len(names))], {}
    while left:
        own = left.pop()
        if len(own) <= most:
            out |= {names[i]: "like " + min(names[j] for j in own) for i in own}
            continue
        some = means[own] - means[own].mean(0)
        main = np.linalg.eigh(some @ some.T)[1][:, -1]  # places along the main direction, but for their scale
        order = sorted(range(len(own)), key=lambda i: (main[i], names[own[i]]))
        left += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray, dims: int):
        others = sorted({v for v in langs if v not in FAMILY_OF})
        means = np.stack([x[langs == v, :-1].mean(0) for v in others]) if others else np.zeros((0, dims))
        group = FAMILY_OF | similar_groups(means, others)
        family = np.array([group[v] for v in langs], object)
        self.dims, self.family = dims, Duels(x, family)
        self.within = [Duels(x[family == f], langs[family == f]) for f in self.family.classes]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            x = np.stack([vector(texts[i], self.dims) for i in some])
            families, sure = self.family.predict(x)
            for f in set(families):
                own = np.flatnonzero(families == f)
                best, also = self.within[f].predict(x[own])
                for o, b, s in zip(own, best, also):
                    langs[some[o]], scores[some[o]] = self.within[f].classes[b], float(sure[o] * s)
        return langs, scores


def fit(df: DataFrame, dims: int = 2048, max_rows: int = 6000) -> Model | None:
    """A model of the rows of (doc_id, text, lang) with a lang and a letter, from at most ``max_rows`` of them, or one of each
    language if there are more languages. Equal rows count once."""
    known = df.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text"))
    # Two rounds of the first rows by hash, without texts: within salts of a language, then of all of it.
    first = known.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        first = first.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("rn") <= max_rows)
    first = written(first.select("lang", "h", "rn"), "first-rows")
    langs = first.select("lang").distinct().count()
    if not langs:
        return None
    each = max(1, max_rows // langs)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x = x.drop_duplicates(["lang", "h"])
            x = x[[has_letter(t) for t in x["text"]]]
            packed = [vector(t, dims).astype(np.float16).tobytes() for t in x["text"]]
            yield pd.DataFrame({"lang": x["lang"], "h": x["h"], "v": packed})

    # At most max_rows rows, or one for each language.
    drawn = known.join(F.broadcast(first.where(F.col("rn") <= each).select("lang", "h")), ["lang", "h"], "left_semi")
    got = drawn.select("text", "lang", "h").mapInPandas(vectors, "lang string, h long, v binary")
    rows = got.groupBy("lang", "h").agg(F.min("v").alias("v")).orderBy("h", "lang").collect()
    if not rows:
        return None
    x = np.stack([np.frombuffer(r.v, np.float16) for r in rows]).astype(np.float32)
    return Model(x, np.array([r.lang for r in rows], object), dims)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def predictor(spark: SparkSession, model: Model | None):
    """A function of a text column: struct of lang_pred and score."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        own, texts = held.value, text.tolist()
        langs, scores = own.predict(texts) if own else ([UND] * len(texts), [0.0] * len(texts))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return run


def _fitted(df: DataFrame) -> Model | None:
    return fit(df.where(~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def language_id(df: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score of every document, learned from those not held out."""
    got = predictor(df.sparkSession, _fitted(df))
    return df.select("doc_id", got("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")


def keep_known(df: DataFrame, least: float = 0.25) -> DataFrame:
    """The rows of df whose language is told with at least that score."""
    got = predictor(df.sparkSession, _fitted(df))
    rows = df.select(F.struct(*df.columns).alias("whole"), got("text").alias("p"))
    return rows.where((F.col("p.lang_pred") != UND) & (F.col("p.score") >= least)).select("whole.*")
