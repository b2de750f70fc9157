"""License scan: exact phrases, and short notices found with bounded errors.

A text is lowered (A-Z) and cut to words of ASCII letters, digits and anything
beyond ASCII; the words are joined by one space. Phrases are counted where their
words stand consecutively. For the notices, each notice that may have ``k``
errors is split into ``k + 1`` pieces: a copy with at most ``k`` errors must hold
one piece unchanged (pigeonhole). Each piece is searched for;
around each hit the text is cut to where the notice can lie, and the regex
library's bounded-error matching verifies it and gives the best span there and
its errors. Of overlapping spans of a notice the one with fewest errors stays.

Cases: a null or empty text has no word, no label and score 0; very long texts
are scanned whole, only windows around hits are matched fuzzily; repeated rows
give repeated results; other columns are not read; an empty table gives an empty
result. Bytes are scanned, so a span counts words, not characters. A notice's
words are ASCII; a word that holds other letters counts as differing bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import worker_cache

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label, notice, errors (inserted, deleted or changed characters) that it may have.
NOTICES = (
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 9),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "this work is licensed under the gnu general public license version 3", 7),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", 9),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("cc-by", "licensed under the creative commons attribution license", 5),
    ("cc-by", "licensed under cc by 4 0", 2),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 9),
    ("mpl", "subject to the terms of the mozilla public license", 5),
    ("reserved", "all rights reserved", 2),
)

#: A-Z to a-z; what is ASCII and neither letter nor digit to a space.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    n = errors + 1
    at = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:])]


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = notices
        found: dict[str, list] = {}
        for k, (_, notice, errors) in enumerate(notices):
            for at, piece in pieces(notice, errors):
                found.setdefault(piece, []).append((k, at))
        self.seeds = [(piece.encode(), uses) for piece, uses in found.items()]
        # Each error spoils at most three of a notice's three-letter pieces; the others stand in any copy.
        self.grams = [([n[i : i + 3].encode() for i in range(len(n) - 2)], len(n) - 2 - 3 * e) for _, n, e in notices]
        # (?b) asks for the best match; the notice must stand between word ends.
        self.fuzzy = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n)}){{e<={e}}}(?= )".encode()) for _, n, e in notices]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int, float]]]:
        """Number of words; (word, label) of each phrase; (label, first word, words, errors, score) of each notice."""
        words = (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()
        joined = b" " + b" ".join(words) + b" " if words else b""
        base = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                base.append((joined.count(b" ", 0, at), label))
                at = joined.find(phrase, at + 1)
        return len(words), base, self._notices(joined) if words else []

    def _notices(self, joined: bytes) -> list[tuple[str, int, int, int, float]]:
        windows: dict[int, set[tuple[int, int]]] = {}
        for piece, uses in self.seeds:
            hit = joined.find(piece)
            while hit >= 0:
                for k, offset in uses:
                    _, notice, errors = self.notices[k]
                    a, b = hit - offset - errors - 1, hit - offset + len(notice) + errors + 1
                    windows.setdefault(k, set()).add((max(0, a), min(len(joined), b)))
                hit = joined.find(piece, hit + 1)
        out = []
        for k, held in windows.items():
            label, notice, _ = self.notices[k]
            grams, need = self.grams[k]
            spans = set()
            for a, b in held:  # each by itself, so that a better copy beside it hides none
                window = joined[a:b]
                if sum(g in window for g in grams) >= need and (m := self.fuzzy[k].search(joined, a, b)):
                    spans.add((sum(m.fuzzy_counts), m.start(), m.end()))
            for n, start, end in self._apart(spans):
                first = joined.count(b" ", 0, start) - 1
                out.append((label, first, joined.count(b" ", start, end) + 1, n, 1 - n / len(notice)))
        return sorted(out, key=lambda x: (x[1], x[0]))

    @staticmethod
    def _apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Of spans that overlap, those with the fewest errors, then the first."""
        out: list[tuple[int, int, int]] = []
        starts: list[int] = []
        for span in sorted(spans):
            at = bisect_left(starts, span[1])
            before, after = (out[at - 1] if at else None), (out[at] if at < len(out) else None)
            if (not before or before[2] <= span[1]) and (not after or span[2] <= after[1]):
                starts.insert(at, span[1])
                out.insert(at, span)
        return out


SCHEMA = (
    "doc_id long, n_words long, phrases array<struct<word:long,label:string>>, "
    "notices array<struct<label:string,first_word:long,n_words:long,errors:long,score:double>>"
)


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES
) -> DataFrame:
    """doc_id, n_words, phrases (each place of each phrase) and notices (each verified span)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache()
        key = ("license", phrases, notices)
        scanner = cache.get(key) or cache.setdefault(key, Scanner(phrases, notices))
        for x in batches:
            got = [scanner.scan(t) for t in x["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": x["doc_id"],
                    "n_words": [g[0] for g in got],
                    "phrases": [[{"word": w, "label": k} for w, k in g[1]] for g in got],
                    "notices": [
                        [dict(zip(("label", "first_word", "n_words", "errors", "score"), n)) for n in g[2]] for g in got
                    ],
                }
            )

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInPandas(run, SCHEMA)
