"""The quality classifier: trees against plain search and plain walks, held-out accuracy, edge inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import boosting

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def plain_score(trees, row):
    total = trees.start
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + (2 if row[f[at]] > t[at] else 1)
        total += leaf[at - len(f)]
    return 1 / (1 + np.exp(-total))


def data(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n), np.ones(n)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 2) ^ (rng.random(n) < 0.05)).astype(float)
    return x, y


def test_walk_of_flat_arrays():
    x, y = data()
    trees = boosting.grow(x, y, trees=15, depth=3)
    assert np.allclose(trees.scores(x), [plain_score(trees, r) for r in x])
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.9


def test_first_split_is_the_best_of_all():
    x, y = data(60)
    x = np.round(x, 1)  # fewer values than bins, so that every threshold is tried
    trees = boosting.grow(x, y, trees=1, depth=1, rate=1.0)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gains = {}
    for f in range(4):
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            a, b = g[left].sum(), g[~left].sum()
            if min(h[left].sum(), h[~left].sum()) >= 2:
                gains[f, t] = a * a / (h[left].sum() + 1) + b * b / (h[~left].sum() + 1)
    best = max(gains, key=gains.get)
    f, t = trees.feature[0, 0], trees.threshold[0, 0]
    assert f == best[0] and best[1] <= t and not ((x[:, f] > best[1]) & (x[:, f] <= t)).any()
    left = x[:, f] <= t
    assert trees.leaf[0, 0] == pytest.approx(-g[left].sum() / (h[left].sum() + 1))


def test_statistics():
    s = dict(zip(boosting.STATISTICS, boosting.statistics("A b a b a b\nA b a b a b\n\n#x 12!")))
    assert len(s) == len(boosting.STATISTICS) and s["repeated_lines"] == pytest.approx(1 / 3)
    assert s["words"] == pytest.approx(np.log1p(14)) and s["symbol_words"] == pytest.approx(1 / 14)
    assert s["distinct_words"] == pytest.approx(5 / 14) and s["stop_words"] == pytest.approx(1 / 14)
    assert not any(boosting.statistics(None)[:10]) and boosting.statistics("") == boosting.statistics(None)


def corpus(n=500):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("etaoin", k=rng.randint(1, 7))) for _ in range(rng.randint(20, 90))]
        good = i % 3 > 0
        rows.append((i, " ".join(words if good else [w + rng.choice(["&&&", "###", ""]) for w in words])))
        labels.append((i, int(good), 0))
    return rows, labels


EDGE = [(None, "a null id"), (9000, None), (9001, ""), (9002, "word " * 30_000), (9003, "same"), (9003, "same"), (9004, "\x00 ퟿")]


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    odd = [(None, 1, 0), (0, None, 0), (1, 7, 0), (9003, 1, 0), (9003, 0, 0)]
    df = spark.createDataFrame(rows + EDGE, DOCS).withColumns({"label": F.lit("x"), "h": F.lit(1), "v": F.lit(None).cast("binary"), "quality": F.lit(0)})
    known = spark.createDataFrame(labels + odd, LABELS).withColumn("text", F.lit("no"))
    got = boosting.classify(df, known).collect()
    assert len(got) == len(rows) + len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {r.doc_id for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000} == held
    truth = {k: q for k, q, _ in labels}
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id == 9003}) == 1
    assert len({r.score for r in got if r.doc_id in (9000, 9001)}) == 1


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(120)
    df = spark.createDataFrame(rows, DOCS)
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in labels]
    one, two = (sorted((r.doc_id, r.score) for r in boosting.classify(df, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert one == two


def test_few_labels(spark):
    rows, labels = corpus(30)
    df, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)
    assert {r.score for r in boosting.classify(df, none).collect()} == {0.5}
    ones = spark.createDataFrame([(k, 1, 0) for k, _, _ in labels], LABELS)
    assert len({r.score for r in boosting.classify(df, ones).collect()}) == 1
    assert boosting.classify(df.limit(0), ones).count() == 0
