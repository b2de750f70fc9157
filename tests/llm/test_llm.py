"""The training-data operators against brute force, round trips and held-out accuracy, with edge inputs."""

import collections
import math
import random
import re
import statistics
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import brown, chat, decontam, html, jaccard, langid, license, packing, quality, warc
from scriptorium.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOWELS = {"en": ["the", "of", "tion", "and", "ing"], "de": ["der", "ung", "sch", "ein", "ü"], "fr": ["eau", "le", "é", "ment", "que"], "es": ["ción", "los", "ado", "ñ", "que"]}


def words(rng, lang, n):
    return ["".join(rng.choices(VOWELS[lang], k=rng.randint(1, 3))) for _ in range(n)]


def corpus(n=240, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en de fr es".split()[i % 4]
        rows.append([i, " ".join(words(rng, lang, rng.randint(60, 200))), lang, f"s{i % 3}", 0])
    return rows


EDGE = [
    [1000, None, None, None, None],
    [1001, "", "en", None, 0],
    [1002, " \n\t ", "en", None, 0],
    [1003, "one two", "en", None, 0],
    [1003, "one two", "en", None, 0],
    [None, "three four five six seven", "en", None, 0],
    [1004, "word " * 20000, "en", "s0", 100000],
    [1005, "12 34 !!", "en", "s0", 8],
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([tuple(r) for r in corpus() + EDGE], DOCS)
    return df.withColumn("Row", F.lit(1)).withColumn("features", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Chat formatting


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "<|im_end|> \\b \\p \\n <\\p <|"),
        (1, 1, "assistant", "a\\"),
        (1, 1, "assistant", None),
        (1, 2, "assistant", "b\n<|im_part|>"),
        (2, 5, "role\n<|x\\n", "x"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = chat.format_conversations(df).withColumn("back", chat.parse_formatted(F.col("formatted")))
    got = {r.conv_id: r for r in got.withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    assert [tuple(t) for t in got[1].back] == [("user", rows[0][3]), ("assistant", ""), ("assistant", "a\\"), ("assistant", "b\n<|im_part|>")]
    assert got[1].loss == "a\\b\n<|im_part|>" and got[1].n_blocks == 2
    assert got[1].formatted.count("<|im_start|>") == 2 and "".join(s.text for s in got[1].segments) == got[1].formatted
    assert [tuple(t) for t in got[2].back] == [("role\n<|x\\n", "x")] and [tuple(t) for t in got[None].back] == [("", "")]
    assert chat.format_conversations(df.limit(0)).count() == 0


# Quality rules


def brute_counts(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(three)
    covered = {i + k for i, x in enumerate(three) if n[x] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), lines, len(covered)


def test_quality(spark, docs):
    odd = [(5000, "a b c a b c d\na b\n\na b\n | # <>", None, None, 0), (5001, "x\x0by\x85z é f", None, None, 0)]
    df = docs.select(*[c.split()[0] for c in DOCS.split(", ")]).unionByName(spark.createDataFrame(odd, DOCS))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(240) if i % 8 < 4] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    junk = spark.createDataFrame([(6000 + i, " | ".join(f"q{i}x{k}" for k in range(80)), "en", "s", 0) for i in range(20)], DOCS)
    got = quality.quality(df, labels).collect()
    texts = collections.defaultdict(list)
    for r in [*corpus(), *EDGE, *odd]:
        texts[r[0]].append(r[1])
    for r in got:
        want = brute_counts(texts[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and (not failed or not r.kept)
    df = docs.select(*junk.columns).where("doc_id < 240").unionByName(junk)  # without the one text of 20,000 equal words
    kept = {r.doc_id for r in quality.quality(df, labels, bits=10).collect() if r.kept}
    assert not any(k in kept for k in range(6000, 6020)) and len(kept & set(range(240))) > 230
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.0}
    assert quality.quality(empty, none).count() == 0


# Licences


def test_license(spark, docs, empty):
    rows = [
        (1, "Under the MIT  License, mit-license; GNU general, public LICENSE"),
        (2, "x This work is licenced under GNU General Publik License, version 3. y"),
        (3, "MIT licenses é mitlicense"),
        (4, None),
        (5, "All rights reserverd"),
    ]
    got = {r.doc_id: r for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(p) for p in got[1].phrases] == [(2, "mit"), (4, "mit"), (7, "gpl")] and got[1].n_words == 10
    assert [(n.label, n.first_word) for n in got[2].notices] == [("gpl", 1)] and got[2].notices[0].errors <= 7
    assert got[3].phrases == [] and got[3].notices == [] and got[4].n_words == 0
    assert [(n.label, n.first_word, n.n_words, n.errors) for n in got[5].notices] == [("reserved", 0, 3, 1)]
    assert license.scan_licenses(docs).count() == 248 and license.scan_licenses(empty).count() == 0


def test_license_pigeonhole_finds_what_the_regex_finds():
    rng, s = random.Random(1), license.Scanner()
    import regex

    for _ in range(150):
        label, notice, k = rng.choice(license.NOTICES)
        t = list(notice)
        for _ in range(rng.randint(0, k)):
            at = rng.randrange(1, len(t) - 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["q", "z", ""])
        text = "foo bar " + "".join(t) + " baz"
        plain = regex.search(rf"(?b)(?<= )(?:{notice}){{e<={k}}}(?= )", f" {' '.join(text.split())} ")
        found = [n for n in s.scan(text)[2] if n[0] == label]
        assert not plain or found


def test_license_beside_a_better_copy():
    found = license.Scanner().scan("All rights reservd all rights reserved; x all rihgts reserved all rights reserved")[2]
    assert [(n[0], n[1], n[2], n[3]) for n in found] == [("reserved", 0, 3, 1), ("reserved", 3, 3, 0), ("reserved", 7, 3, 2), ("reserved", 10, 3, 0)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_license_notices_both_ways():
    """Every span found is one by its edits, and every span of words within the bound meets one found with no more errors."""
    rng = random.Random(12)
    notices = (("a", "all rights reserved", 2), ("b", "licensed under cc by 4 0", 2), ("c", "subject to the terms", 3))
    s = license.Scanner(notices=notices)
    for _ in range(40):
        words = []
        for _ in range(rng.randint(1, 5)):
            t = list(rng.choice(notices)[1])
            for _ in range(rng.choice([0, 1, 2, 4])):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["q", "", " ", "s"])
            words += "".join(t).split() + ["w"] * rng.randint(0, 2)
        found = s.scan(" ".join(words))[2]
        for label, first, n, errors, _ in found:
            notice = next(x for x in notices if x[0] == label)
            assert edits(" ".join(words[first : first + n]), notice[1]) == errors <= notice[2]
        for label, notice, k in notices:
            own = [(f, f + n, e) for x, f, n, e, _ in found if x == label]
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
            for i in range(len(words)):
                for j in range(i + 1, min(len(words), i + 9) + 1):
                    n = edits(" ".join(words[i:j]), notice)
                    assert n > k or any(a < j and i < b and e <= n for a, b, e in own), (words, label, i, j, n, own)


# Language


def test_language(spark, docs, empty):
    got = langid.language_id(docs).collect()
    truth = {r[0]: r[2] for r in corpus()}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002, 1005))
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 248
    assert langid.language_id(empty).count() == 0
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_no_language_is_lost(spark):
    """As many rows as languages: a model holds each; so do copies and rows without letters not take a language's place."""
    rows = [(i, f"{chr(0x4E00 + 5 * lang)} text{i // 249 % 30}", f"x{lang:03}", "s", 0) for i, lang in enumerate([k % 249 for k in range(249 * 4)] + [0] * 500)]
    rows += [(i + 10_000, "12 34", f"n{i:03}", "s", 0) for i in range(51)]
    for most in (300, 100):
        model = langid.fit(spark.createDataFrame(rows, DOCS).select("doc_id", "text", "lang"), dims=256, max_rows=most)
        assert sum(len(d.classes) for d in model.within) == 249


def test_many_languages(spark):
    """Each language can be predicted, however many there are; a frequent one does not crowd out the rest."""
    rows = [(i, " ".join(chr(0x4E00 + 3 * lang + j) for j in range(3)) + " ab", f"x{lang:02}", "s", 0)
            for i, lang in enumerate([k % 70 for k in range(420)] + [0] * 300)]
    model = langid.fit(spark.createDataFrame(rows, DOCS).select("doc_id", "text", "lang"), dims=512, max_rows=350)
    langs, _ = model.predict([r[1] for r in rows[:70]])
    assert {v for d in model.within for v in d.classes} == {r[2] for r in rows[:70]}
    assert max(len(d.classes) for d in model.within) <= 8 and len(model.within) <= 18
    assert len(model.family.pairs) + sum(len(d.pairs) for d in model.within) < 70 * 69 / 2 / 5
    assert np.mean([a == r[2] for a, r in zip(langs, rows)]) > 0.9


def test_similar_languages_share_a_group():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 50)) * [[8], [4], [2], [1]]
    names = [f"l{i:02}" for i in range(32)]
    means = np.stack([centre[i % 4] + rng.normal(size=50) / 50 for i in range(32)])
    got = langid.similar_groups(means, names)
    assert set(got) == set(names) and all(got[n] == got[names[int(n[1:]) % 4]] for n in names)
    assert len(set(got.values())) == 4 and langid.similar_groups(means[:5], names[:5]) == dict.fromkeys(names[:5], "like l00")
    assert langid.similar_groups(np.zeros((0, 50)), []) == {} and len(langid.similar_groups(np.zeros((20, 50)), names[:20])) == 20


def test_duels_against_each_two_fitted_alone():
    """Each machine is the one of its two classes alone, and the winner that of the most duels by plain counting."""
    rng = np.random.default_rng(4)
    y = np.array([f"c{i % 5}" for i in range(100)], object)
    x = np.concatenate([rng.normal(size=(100, 12)) + np.arange(5)[np.arange(100) % 5, None] * rng.normal(size=12), np.ones((100, 1))], 1).astype(np.float32)
    d = langid.Duels(x, y)
    best, score = d.predict(x)
    for r in range(100):
        wins, total, least = collections.Counter(), collections.Counter(), {}
        for a in range(5):
            for b in range(a + 1, 5):
                some = [i for i in range(100) if y[i] in (f"c{a}", f"c{b}")]
                w = d.weights[:, d.pairs.index((a, b))]
                if r == 0:
                    assert np.allclose(w, langid.fit_svm(x[some], np.where(y[some] == f"c{a}", 1.0, -1.0)))
                m = float(x[r] @ w)
                for side, v in ((a, m), (b, -m)):
                    wins[side] += v > 0
                    total[side] += v
                    least[side] = min(least.get(side, v), v)
        want = max(range(5), key=lambda k: (wins[k], total[k]))
        assert best[r] == want and score[r] == pytest.approx(1 / (1 + math.exp(-4 * least[want])), rel=1e-4)


def test_vector_in_pieces(monkeypatch):
    text = "abcdé " * 50
    whole = langid.vector(text, 512)
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert np.allclose(whole, langid.vector(text, 512))


# Near duplicates


def brute_classes(rows, t=0.8):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= t * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))], links


def copies(seed=9):
    rng, rows = random.Random(seed), corpus(60, seed)
    base = rows[0][1].split()
    for k in range(150):  # a large group whose members differ
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{k}"
        rows.append([100 + k, " ".join(w), "en", "s", 0])
    shared = " ".join(f"common{i}" for i in range(30))
    rows += [[400 + k, shared + " " + " ".join(words(rng, "en", 80)), "en", "s", 0] for k in range(100)]
    rows += [[600 + k, rows[1][1], "en", "s", 0] for k in range(40)]
    return rows + [[700 + i, t, None, None, None] for i, t in enumerate([None, "", " ", "a b", "A B", "a b c"])]


@pytest.mark.parametrize("small, block, bits", [(64, 512, 24), (8, 16, 24), (64, 512, 7)])
def test_near_duplicates(spark, small, block, bits):
    rows = copies()
    got = jaccard.near_duplicates(spark.createDataFrame([tuple(r) for r in rows], DOCS), small=small, block=block, sketch_block=4 * block, filter_bits=bits).collect()
    classes, links = brute_classes(rows)
    first = {}
    for c, r in zip(classes, rows):
        first[c] = min(first.get(c, 10**9), r[0])
    want = {r[0]: (first[c], n) for c, r, n in zip(classes, rows, links)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want


def test_keep_one(spark, docs, empty):
    rows = copies()
    df = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(brute_classes(rows)[0]))
    assert jaccard.keep_one(docs).where("doc_id = 1003").count() == 1
    assert jaccard.keep_one(docs).where("doc_id IS NULL").count() == 1
    assert jaccard.near_duplicates(empty).count() == 0


def test_sampling_rate():
    rng = np.random.default_rng(0)
    hits = []
    for _ in range(2000):
        t = np.unique(jaccard._mix(rng.integers(0, 2**63, 100).astype(np.uint64)))
        hits.append(len(jaccard.chosen(t, 4, 0.8)) / 4)
    assert 1.15 < np.mean(hits) < 1.35
    assert len(jaccard.chosen(t[:1], 7, 0.8)) == 7 and len(jaccard.chosen(t[:0], 7, 0.8)) == 0
    assert jaccard.runs_for(0.9999, 0.8) == 13


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}


# Decontamination


def full_score(item, text):
    a, b = decontam.words_of(item), decontam.words_of(text)
    table, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
            best = max(best, table[i, j])
    return best / (2 * len(a)) if a else 0


def test_leaks(spark, empty):
    rng, rows = random.Random(3), corpus(60, 4)
    items = [(i, " ".join(f"{w}{rng.randint(0, 99)}" for w in words(rng, "en", 30))) for i in range(6)] + [(6, None), (7, "two words")]
    for k, (i, text) in enumerate(items[:6]):
        w = text.split()
        if k % 2:
            w[5], w[20:22] = "changed", []
        rows[k * 5][1] += " " + " ".join(w) + " end"
    rows[40][1] += " " + " ".join(items[0][1].split()[:5])
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([tuple(r) for r in rows + EDGE], DOCS)
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(df, bench).collect()}
    want = {(r[0], i): s for r in rows for i, t in items[:6] if (s := full_score(t, r[1])) >= 0.4}
    assert set(got) == set(want) and all(got[k].score == pytest.approx(s) for k, s in want.items())
    assert set(got) == {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench, block_items=2).collect()}
    kept = decontam.without_leaks(df, bench)
    assert kept.count() == len(rows) + len(EDGE) - 6 and kept.columns == df.columns
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 and decontam.find_leaks(empty, bench).count() == 0


def test_leaks_of_repeated_and_long_items(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(6000))
    short = "alpha7 beta8 gamma9 delta1 epsilon2 zeta3"
    docs = spark.createDataFrame([(1, f"so {short} it"), (2, long), (2, long), (3, " ".join(long.split()[3000:3040])), (4, "none of it")], "doc_id long, text string")
    docs = docs.withColumns({"item_id": F.lit(5), "score": F.lit("s"), "whole": F.lit(None)})
    bench = spark.createDataFrame([(1, short), (1, short), (2, long)], "item_id long, text string")
    for size in (16 << 20, 20_000):
        got = collections.Counter((r.doc_id, r.item_id, r.first_word, r.n_words) for r in decontam.find_leaks(docs, bench, block_bytes=size).collect())
        assert got == {(1, 1, 1, 6): 2, (2, 2, 0, 6000): 2, (3, 2, 0, 40): 1}
        assert [r.doc_id for r in decontam.without_leaks(docs, bench, block_bytes=size).collect()] == [4]


def test_seed_keys_of_many_words():
    """Hits equal those of plain comparison where words' numbers are too large for one product of three."""

    class Many(dict):
        def __len__(self):
            return 2**22

    rng = np.random.default_rng(5)
    items = decontam.Items([(i, " ".join(f"t{v}" for v in rng.integers(0, 12, 9))) for i in range(20)])
    items.vocabulary = Many({w: i for w, i in items.vocabulary.items()})
    items.choose(np.full(2**22, 1e-6), 1e-8, 4)
    shift = 2**22 - 20
    large = decontam.Items([(i, "") for i in range(20)])
    large.words, large.vocabulary = [w + shift for w in items.words], items.vocabulary

    large.choose(np.full(2**22, 1e-6), 1e-8, 4)
    text = rng.integers(0, 12, 400)
    for one, low in ((items, 0), (large, shift)):
        k, begins = one.hits(text + low)
        plain = sorted((j, at - p) for j, w in enumerate(items.words) for p in range(7) for at in range(398) if (text[at : at + 3] == w[p : p + 3]).all())
        assert sorted(zip(k.tolist(), begins.tolist())) == plain and len(plain) > 10


# WARC


def archive(n=8):
    return [warc.member(warc.record("response", i, f"http://x/{i}", b"p%d" % i * 40, warc.digest32(b"p%d" % i * 40))) for i in range(n)]


def test_salvage_members():
    parts = archive()
    data = bytearray(b"".join(parts))
    at = len(parts[0]) + 30
    data[at : at + 20] = b"\x1f\x8b\x08" + b"\0" * 17
    data = bytes(data[:-5]) + b"trailing"
    found = list(warc.salvage(data))
    ids = [r["head"]["warc-page-id"] for k, _, _, r in found if k == "record"]
    gaps = [(a, b) for k, a, b, _ in found if k == "gap"]
    # The last member has lost the end of its checksum, but its record has passed its own digests.
    assert ids == list("0234567") and len(gaps) == 2
    assert gaps[0] == (len(parts[0]), len(parts[0]) + len(parts[1])) and gaps[1][1] == len(data)


def test_salvage_plain():
    raw = [warc.record("response", i, None, b"abc%d" % i, warc.digest32(b"abc%d" % i)) for i in range(4)]
    data = b"junk" + raw[0] + raw[1][:-9] + raw[2].replace(b"abc2", b"abX2") + raw[3]
    found = list(warc.salvage(data))
    assert [r["head"]["warc-page-id"] for k, _, _, r in found if k == "record"] == ["0", "3"]
    spans = sorted({(a, b) for _, a, b, _ in found})
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    assert list(warc.salvage(b"")) == [] and [k for k, *_ in warc.salvage(b"nothing")] == ["gap"]


def names_of(data):
    return [r["head"]["warc-page-id"] for k, _, _, r in warc.salvage(data) if k == "record" and not r["suspect"]]


def test_salvage_inside_members():
    raw = [warc.record("response", i, None, b"abc%d" % i * 50, warc.digest32(b"abc%d" % i * 50)) for i in range(6)]
    bad = raw[2].replace(b"abc2abc2", b"abc2abX2", 1)
    data = warc.member(b"".join([*raw[:2], bad, *raw[3:]])) + warc.member(raw[0])
    assert names_of(data) == list("013450")
    assert [x[:13] for k, _, _, x in warc.salvage(data) if k == "gap"] == ["in the member"]
    rng = random.Random(3)
    big = [warc.record("response", i, None, p := rng.randbytes(3000), warc.digest32(p)) for i in range(30)]
    whole = warc.member(b"".join(big))
    got = names_of(whole[: len(whole) // 2])  # one member that is cut short, then one with a fault in its middle
    assert got == [str(i) for i in range(len(got))] and len(got) >= 13
    broken = bytearray(whole)
    broken[len(whole) // 2 : len(whole) // 2 + 8] = b"\xff" * 8
    got = names_of(bytes(broken) + warc.member(raw[5]))
    assert len(got) >= 10 and got[-1] == "5"


def test_salvage_quoted_records_and_bare_line_feeds():
    raw = [warc.record("response", i, None, b"abc%d" % i, warc.digest32(b"abc%d" % i)) for i in range(3)]
    quote = warc.record("response", 99, None, b"quoted", warc.digest32(b"quoted"))
    outer = warc.record("response", 7, None, quote + b"tail", "WRONG")
    assert names_of(raw[0] + outer + raw[1]) == ["0", "1"]
    cut = outer[: outer.index(b"tail")]  # its length leads nowhere now, so the quoted one is found, and marked
    found = [(r["head"]["warc-page-id"], r["suspect"]) for k, _, _, r in warc.salvage(raw[0] + cut + raw[1]) if k == "record"]
    assert found[0] == ("0", False) and ("99", True) in found
    plain = [b"WARC/1.0\nWARC-Type: resource\nWARC-Page-ID: %d\nContent-Length: 5\n\nab\ncd\n\n" % i for i in range(3)]
    assert names_of(b"".join(plain)) == list("012") and names_of(warc.member(b"".join(plain))) == list("012")


def test_round_trip(spark):
    rows = [(3, "http://a/\n b", "<p>é"), (1, None, "<p>é"), (2, "u", None), (4, "u", ""), (5, "u", "x" * 300000), (3, "again", "<p>é"), (None, "u", "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = warc.round_trip(df.repartition(3)).collect()
    assert all(r.kind == "record" for r in got) and len(got) == 7
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    same = {(1, "response", None, 5): 1, (3, "revisit", 1, 5): 2, (2, "response", None, 0): 1, (4, "revisit", 2, 0): 1}
    assert kinds == same | {(5, "response", None, 300000): 1, (None, "response", None, 1): 1}
    big = next(r for r in got if r.page_id == 5)
    assert big.payload == b"x" * 300000 and big.payload_digest == warc.digest32(big.payload)
    assert warc.round_trip(df.limit(0)).count() == 0


# HTML


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
    <nav><ul><li><a href="/x">Menu</a><li>Two</ul></nav><!-- ad --><div class="top ad">Buy</div><div id=cookie-notice>We use</div>
    <article><header><h1>Title &amp; more</h1></header><p>One <b>two<br>three</p><p>Four\n  five&nbsp;six<div class="comments">Nice!</div><aside>Side</aside><form>Mail <input></form></article>
    <section class="comments"><article class="comment">Hi</article></section><footer>&copy; me</footer></body></html>"""
    read = html.Page(page)
    assert read.main_text(read.named) == "Title & more One two three Four five six"
    kept = """<article><h2 id="related-work">Related</h2><section id="search-algorithms">Search</section><p style="overflow:hidden">Over</p>
    <p title="A hidden gem, 5 > 4">Gem</p><div data-id="promo-1" class="side-by-side">Pair</div><p class="no-ads-here">None</p>
    <div class="ad-box">Buy</div><div id="comment-list">Nice</div><p hidden>Gone</p><h2 class="ad">Ad</h2></article>"""
    read = html.Page(kept)
    assert read.main_text(read.named) == "Related Search Over Gem Pair None"
    for odd in (None, "", "   ", "<", "<p", "<a href='x", "a < b && c", "<!-- open", "<script>x"):
        html.Page(odd).main_text(frozenset())
    assert html.Page("plain &lt;text&gt;").main_text(frozenset()) == "plain <text>"
    html.Page("<div>" * 3000 + "deep").main_text(frozenset())


def test_site_style_tree(spark):
    page = "<html><body><div><p>Follow our news today</p><ul><li>Home<li>About</ul></div><div class=text><p>Unique {i} here<p>and {j} more</div><div>Made by us</div></body>"
    rows = [(i, f"http://Host.example/{i}", page.format(i=f"w{i}", j=i * i)) for i in range(12)]
    rows += [(100, "http://other/1", page.format(i="x", j="y")), (101, None, None), (102, "no url", "<p>t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(got[i] == f"Unique w{i} here and {i * i} more" for i in range(12))
    assert got[100].startswith("Follow our news") and got[101] == "" and got[102] == "t"
    assert html.extract(df.limit(0)).count() == 0


def test_style_tree_judges_inside_and_outside_articles(spark):
    page = "<body><article><h1>Title {i}</h1><p>Story {i} here</p><div class=box>Tell your friends</div></article><div class=more>Also {i} there</div><div>Made by us</div></body>"
    card = "<body><article class=card>Top story of the day</article><div class=story><p>Long text {i}</div></body>"
    rows = [(i, f"http://host/{i}", page.format(i=f"w{i}")) for i in range(12)]
    rows += [(20 + i, f"http://cards/{i}", card.format(i=f"w{i}")) for i in range(12)]
    rows += [(40 + i, f"http://mirror/{i}", page.format(i="same")) for i in range(6)]
    rows += [(60, "http://alone/", page.format(i="x"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(got[i] == f"Title w{i} Story w{i} here Also w{i} there" for i in range(12))
    assert all(got[20 + i] == f"Long text w{i}" for i in range(12))
    assert all(got[40 + i] == "Title same Story same here Tell your friends" for i in range(6))
    assert got[60] == "Title x Story x here Tell your friends"


def _plain_branches(pages, least=0.3, min_pages=4, decay=0.9):
    """removed of each host by plain loops over all pages, as the docstring of the module says."""
    hosts = collections.defaultdict(list)
    for host, source in pages:
        hosts[host].append(html.Page(source))
    out = {}
    for host, read in hosts.items():
        m, seqs, texts = collections.Counter(), collections.defaultdict(list), collections.defaultdict(lambda: collections.defaultdict(set))
        chars, links, shown, above = (collections.Counter() for _ in range(4))
        main, named = set(), set()
        for n, page in enumerate(read):
            total = sum(len(t) for _, t, p, _ in page.blocks if p)
            for path, tags in page.children.items():
                if path:
                    m[path[-1]] += 1
                    seqs[path[-1]].append(tuple(tags))
                    shown[path[-1]] += total
                    above[path[-1]] = path
            for _, t, p, linked in page.blocks:
                if p:
                    chars[p[-1]] += len(t)
                    links[p[-1]] += linked
                    texts[p[-1]][t].add(n)
            main |= page.mains
            named |= page.named
        importance = {}
        for p in m:
            if m[p] < max(min_pages, 2):
                entropy = 1.0
            elif p in texts:
                entropy = 1 - statistics.mean(math.log(len(who)) / math.log(m[p]) for who in texts[p].values())
            else:
                entropy = -sum(k / m[p] * math.log(k / m[p], m[p]) for k in collections.Counter(seqs[p]).values())
            plain = 1 - (links[p] / chars[p] if chars[p] else 0)
            if m[p] >= max(min_pages, 2) or p in named:
                importance[p] = html.PRIOR + (1 - html.PRIOR) * entropy if p in main else entropy * plain
        low = set()
        for b in importance:
            inside = [p for p in importance if b in above[p]]
            weights = [decay ** (len(above[p]) - 1 - above[p].index(b)) * (1.0 if p in texts else 0.1) for p in inside]
            mean = sum(w * importance[p] for w, p in zip(weights, inside)) / sum(weights)
            most = max([importance[p] for p in inside if p in texts], default=0.0)
            holds = m[b] >= max(min_pages, 2) and sum(chars[p] for p in inside) >= html.HOLDS * shown[b]
            prior = html.NAMED if b in named and not holds else 1.0
            if prior * mean < least and prior * most < least:
                low.add(b)
        out[host] = {b for b in low if low.isdisjoint(above[b][:-1])}
    return out


def test_style_tree_equals_plain_loops(spark):
    page = (
        "<html><body class=page{x}><nav><ul><li><a href=/{i}>w{i}</a><li><a href=/>Home</a></ul></nav><div class=m{x}><a href=/>all {i}</a></div>"
        "<article><h1>T {i}</h1><p>Story {i}<p>of {x}<div class=comments id=c-{i}><article><p>Me {i}</p></article></div></article>"
        "<div class=more><p>Also {x}</div><footer>By us {i}</footer></body></html>"
    )
    rows = [(i, f"http://host{i % 3}/{i}", page.format(i=i, x=i % 5)) for i in range(60)]
    rows += [(100 + i, f"http://few/{i}", page.format(i=i, x=0)) for i in range(3)]
    rows += [(200 + i, f"http://wrap/{i}", f"<body><div class=sidebar><article><p>The words {i} are all here and more</article></div><footer>Us</footer>") for i in range(5)]
    rows += [(300, None, None), (301, None, "<p>t"), (302, "x", "<div>" * 50 + "deep " * 100000)] + [(303, "http://again/", page.format(i=1, x=1))] * 6
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = df.withColumn("host", html._host())
    got = {r.host: set(r.removed) for r in html.branches(html.style_tree(pages), 0.3, 4, 0.9).collect()}
    want = _plain_branches([(r.host, r.html) for r in pages.collect()])
    assert {h: b for h, b in got.items() if b} == {h: b for h, b in want.items() if b}
    texts = collections.defaultdict(set)
    for r in html.extract(df.withColumn("removed", F.lit(1)).withColumn("salt", F.lit(2))).collect():
        texts[r.page_id].add(r.text)
    assert all(texts[i] == {f"T {i} Story {i} of {i % 5}" + (" Also %d" % (i % 5) if "Also" in min(texts[i]) else "")} for i in range(60))
    assert all(texts[100 + i] == {f"T {i} Story {i} of 0"} for i in range(3))
    assert all(texts[200 + i] == {f"The words {i} are all here and more"} for i in range(5))
    assert len(texts[302].pop()) == 499_999 and texts[300] == {""}


# Language model


def test_brown(spark, docs, empty):
    rows = [r for r in docs.select("doc_id", "text").collect()]
    got = collections.defaultdict(list)
    for r in brown.score(docs, n_head=50, n_types=20, n_signatures=8, n_classes=6).collect():
        got[r.doc_id].append(r)
    counts = collections.Counter()
    hold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for r in rows:
        if not hold(r.doc_id):
            counts.update(brown.tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = brown.tokens(r.text)
        x = got[r.doc_id][0]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert x.held_out == hold(r.doc_id) and x.n_tokens == len(t) and x.train_tokens == n
        assert x.n_known == sum(counts[w] > 0 for w in t) and x.base_score == pytest.approx(base)
    held = [got[r.doc_id][0] for r in rows if hold(r.doc_id)]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert brown.score(empty).count() == 0


def test_brown_score_is_a_probability(spark, docs):
    train = docs.where("doc_id < 40").select("text")
    model, counts, limit = brown.fit(train, 10**6, 20, 8, 6, 4)
    types = model.types
    emitted = np.zeros(len(model.step))
    for w, n in zip(types.words, types.counts):
        k = types.types[types.place[w]]
        emitted[model.classes[k]] += 10 ** (model.spare[k] + math.log10(n + 1))
    assert np.all(emitted <= 1 + 1e-6) and np.allclose((10**model.step).sum(1), 1)


@pytest.mark.parametrize("n_head", [50, 10**6])
def test_brown_rescored_by_hand(spark, docs, n_head):
    size = dict(n_head=n_head, n_types=20, n_signatures=8, n_classes=6, rounds=4)
    hold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    some = docs.withColumns({"word": F.lit("x"), "uid": F.lit(7), "k": F.lit(None), "n": F.lit(1), "c": F.lit("c"), "types": F.lit(0)})
    rows = [(r.doc_id, brown.tokens(r.text)) for r in some.select("doc_id", "text").collect()]
    train = [t for i, t in rows if not hold(i)]
    model, _, _ = brown.fit(some.where(~brown.is_held_out(F.col("doc_id"))), **size)

    def of(word):
        return int(model.classes[model.types.of([word])[1][0]])

    words_n, class_n, steps, before = (collections.Counter() for _ in range(4))
    for t in train:
        for a, b in zip([brown.END, *t], t):
            words_n[b] += 1
            class_n[of(b)] += 1
            steps[of(a), of(b)] += 1
            before[of(a)] += 1
    distinct = collections.Counter(of(w) for w in words_n)

    def by_hand(t):
        total = 0.0
        for a, b in zip([brown.END, *t], t):
            total += math.log10((steps[of(a), of(b)] + 1) / (before[of(a)] + size["n_classes"] + 1))
            if b != brown.END:
                total += math.log10((words_n[b] + 1) / (class_n[of(b)] + distinct[of(b)] + 1))
        return total

    got = collections.defaultdict(list)
    for r in brown.score(some, **size).collect():
        got[r.doc_id].append(r.score)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        assert got[i][0] == pytest.approx(by_hand(t), rel=1e-9), i


def test_brown_clusters_words_beyond_the_first_types(spark):
    rng = np.random.default_rng(2)
    a, b = [f"a{i}x{i * 7919}" for i in range(40)], [f"b{i}x{i * 104729}" for i in range(40)]
    rows = [(" ".join(w for _ in range(20) for w in ("the", a[rng.integers(40)], "of", b[rng.integers(40)])),) for _ in range(100)]
    df = spark.createDataFrame(rows, "text string")

    def mixed(more_rounds):
        model, _, _ = brown.fit(df, 10**6, 2, 64, 6, 6, more_rounds=more_rounds)
        of = lambda w: model.classes[model.types.types[model.types.place[w.encode()]]]
        return {of(w) for w in a} & {of(w) for w in b}

    assert mixed(0) and not mixed(3)


def test_exchange_gains():
    rng = np.random.default_rng(1)
    b = rng.integers(0, 3, (21, 21)).astype(float)
    b[1:11, 11:] += 20
    b[11:, 1:11] += 20
    of = brown.exchange(b, 2, 10)
    assert len(set(of[1:11])) == 1 and len(set(of[11:])) == 1 and of[1] != of[11] and of[0] == 2


# Packing


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_encoder_is_exact():
    from tokenizers import Tokenizer

    rng, tok, own = random.Random(2), Tokenizer.from_file(tokenizer()), packing.Encoder(tokenizer())
    texts = ["", " ", "A b's it's 12 é́x   İI ΑΣ!? <|endoftext|>x a<|startoftext|>", "don't stop\tnow\r\nx--y_z 3.14", " x\x1cy"]
    texts += ["".join(rng.choices("aB é.,'sT12<|\n\t-日", k=60)) for _ in range(300)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_pack(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    got = packing.pack(docs, tokenizer(), max_len=2048, keep_ids=True).toPandas()
    have = collections.Counter()
    for (d, _), x in got.fillna({"doc_id": -1}).groupby(["doc_id", "doc_tokens"]):
        for start, rows in x.groupby("start"):
            have[(d, start)] += len(rows)
    for r in docs.select("doc_id", "text").distinct().collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        x = got[got.doc_id.isna() if r.doc_id is None else got.doc_id == r.doc_id].drop_duplicates("start").sort_values("start")
        assert [i for p in x.ids for i in p] == ids and set(x.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(x.ids, x.ids_crc32))
    assert have[(1003, 0)] == 2
    x = got.sort_values(["sequence_id", "offset"])
    assert ((x.groupby("sequence_id").length.cumsum() - x.length) == x.offset).all()
    fill = x.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and fill.sum() / (2048 * len(fill)) > 0.95
    assert packing.pack(empty, tokenizer()).count() == 0


def test_column_generation():
    rng = np.random.default_rng(4)
    for units in (16, 64):
        demand = np.zeros(units + 1, int)
        np.add.at(demand, rng.integers(1, units + 1, 5000), 1)
        plan = packing.column_generation(demand)
        used = sum(p * n for p, n in plan)
        assert (used == demand).all() and all((p * np.arange(units + 1)).sum() <= units for p, _ in plan)
        least = (demand * np.arange(units + 1)).sum() / units
        assert sum(n for _, n in plan) <= 1.02 * least + units
    assert packing.column_generation(np.zeros(9, int)) == []


def test_knapsack():
    value = np.array([-1, 1.0, 3.1, 4.0, 0.2, 9.5])
    best, pattern = packing.best_pattern(value, 5)
    assert best == pytest.approx(9.5) and pattern.tolist() == [0, 0, 0, 0, 0, 1]


# Pipeline


def test_pipeline(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C

    rows = corpus(120, 8)
    rows += [[300 + k, rows[k][1], "en", "s", 0] for k in range(10)] + [[400, "short", "en", "s", 0]]
    rng = random.Random(6)
    item = " ".join(f"{w}{rng.randint(0, 99)}" for w in words(rng, "en", 30))
    rows[20][1] += " " + item
    spark.createDataFrame([tuple(r) for r in rows + EDGE], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, str(tmp_path)).toPandas()
    kept = set(got.doc_id)
    assert 20 not in kept and 400 not in kept and not kept & set(range(300, 310)) and not kept & {1000, 1001, 1002, 1003, 1004, 1005}
    assert len(kept & set(range(120))) > 110
    assert [n for n, _ in C.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "benchmark decontamination", "packing"]
