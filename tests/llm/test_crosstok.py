"""Cross-tokenizer alignment against whole texts encoded without pieces, and byte offsets compared one by one."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import crosstok

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None,
    "",
    " ",
    "  two  spaces \n\n and\tmore   end ",
    "▁ mark",
    "<|endoftext|> <s> <0x41> </s> plain",
    "café naïve 中文 \U0001f600 é ´x ᠎ y  z",
    "don't can't 12345 a1b2 ::-- (x) ...",
    "x" * 3000,
    "a\x00b \x1c c​d ﻿e",
    "word " * 4000,
    "tie tie tie",
    "tie tie tie",
]


def plain(texts):
    """Per text: ids, groups and links from whole texts, with sets of offsets."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    of = crosstok.signs_to_bytes()
    out = []
    for text in texts:
        ids_a, ids_b = [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = []
        for i in ids_b:
            p = b.id_to_piece(i)
            raw_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            out.append([])
            continue
        groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b and i < len(ids_a):
                groups[-1][0].append(ids_a[i])
                at_a += len(raw_a[i])
                i += 1
            else:
                groups[-1][1].append(ids_b[j])
                at_b += len(raw_b[j])
                j += 1
            if at_a == at_b and i + j < len(ids_a) + len(ids_b):
                groups.append(([], []))
        out.append(groups)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    syllables = ["the", "tion", "é", "ing", "ü", "x", "99", "'s", "Qu", "-", "\n", "  "]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [*enumerate(texts), *[(None if i == 3 else 1000 + i // 2, t) for i, t in enumerate(ODD)]]


def test_alignment_and_counts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"links": F.lit(1), "row": F.lit("x"), "uid": F.lit(2)})
    got = crosstok.link_statistics(crosstok.align(df.repartition(3), *PATHS)).collect()
    want = plain([t for _, t in rows])
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in want]
    held = collections.Counter(k for n in links for k in n)
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    expected = collections.Counter()
    for (doc_id, _), g, n in zip(rows, want, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(k for p, k in n.items() if held[p] == most[p[0]])
        total = sum(k * held[p] for p, k in n.items())
        expected[doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(n.values()), best, total, text] += 1
    assert collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == expected
    assert any(len(a) > 1 and len(b) > 1 for g in want for a, b in g) and sum(not g for g in want) >= 3


def test_rare_pairs_go_by_join(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows[:60], "doc_id long, text string")
    keys = ["doc_id", "n_best", "count_sum"]
    one = sorted(tuple(r[k] for k in keys) for r in crosstok.link_statistics(crosstok.align(df, *PATHS)).collect())
    monkeypatch.setattr(crosstok, "HOT", 0.01)
    assert one == sorted(tuple(r[k] for k in keys) for r in crosstok.link_statistics(crosstok.align(df, *PATHS)).collect())


def test_pieces_forgotten(monkeypatch, rows):
    want = plain([t for _, t in rows])
    monkeypatch.setattr(crosstok, "REMEMBERED", 7)
    own = crosstok.Aligner(*PATHS)
    for (_, text), g in zip(rows, want):
        got = own.align(text)
        assert ";".join(x.listing for x in got or []) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)


def test_labels():
    line = crosstok.labels(crosstok.np.array([2, 3, 6]), crosstok.np.array([1, 3, 4, 6]), 6)
    assert line == b"baxb.x" and [crosstok.Sizes()[g] for g in crosstok._GROUP.findall(line)] == [(2, 2), (1, 2)]


def test_query_digest_and_empty(spark, tmp_path, rows):
    from scriptorium.llm.queries import QUERIES

    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_cross_tokenizer_alignment"](spark, str(tmp_path)).collect()}
    g = plain([rows[5][1]])[0]
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
    assert got[5].groups_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[1000].groups_sha256 == "" and got[1000].n_best == 0
    assert crosstok.link_statistics(crosstok.align(df.limit(0), *PATHS)).count() == 0


def test_no_python_call_for_each_group():
    import sys

    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh-/0123456789") for _ in range(20_000))
    own, calls = crosstok.Aligner(*PATHS), 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    own.align(text)  # the sizes of its groups are known then
    own.known.clear()
    sys.setprofile(seen)
    try:
        got = own.align(text)
    finally:
        sys.setprofile(None)
    want = plain([text])[0]
    assert [x.listing for x in got] == [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)]
    assert sorted(crosstok.np.frombuffer(got[0].pairs, crosstok.np.int64)) == sorted(x << 32 | y for a, b in want for x in a for y in b)
    assert len(want) > 3000 and calls < len(want) / 2


def test_remembered_pieces_are_small(monkeypatch):
    import tracemalloc

    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("aeinrstdé", k=rng.randint(5, 11))) for _ in range(1000)) for _ in range(12)]
    own = crosstok.Aligner(*PATHS)
    own.align(texts[0])
    held, n = len(own.known), 0
    tracemalloc.start()
    try:
        for text in texts[1:]:
            own.align(text)
        n = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert n / (len(own.known) - held) < 300  # twice REMEMBERED pieces are 150 MB at most
    monkeypatch.setattr(crosstok, "STRETCH", 3)
    for text in [*texts[:2], "▁ mark", "  two  spaces \n\n and\tmore   end "]:
        got, want = own.align(text), plain([text])[0]
        assert ";".join(x.listing for x in got or []) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
        assert sum(x.n_groups for x in got or []) == len(want)
