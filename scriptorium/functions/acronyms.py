"""Acronyms of titles and abstracts: a masked word list, then a rule on the letters of each word.

A word is an acronym if it has two capitals or more and at least as many
capitals as small letters and digits together. Before that, markup, boilerplate,
numbers and units are masked, and texts in capitals are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.functions.text import U, _each, let, tokens

_TAG = r"(?i)</?(?:sub|sup|super|i|b|exp|fraction)>"


def remove_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[A-Za-z])\.(?=[A-Z])", "")


def capitals(w: Column) -> Column:
    return F.length(F.regexp_replace(w, r"\P{Lu}", ""))


def is_acronym(w: Column) -> Column:
    rest = F.length(F.regexp_replace(w, r"[^\p{Ll}\p{Nd}]", ""))
    return w.rlike(r"(?s)\p{Lu}.*\p{Lu}") & (capitals(w) >= rest)


def is_all_caps(w: Column) -> Column:
    return w.rlike("^[A-Z]{2,}$")


def _masked(c: Column, phrases: str, colon: bool) -> Column:
    """c with a mark for each phrase, one phrase after the other; a text in which none stands is searched once."""
    tail, new = (r":?\s*", "DUMMYDUMMY ") if colon else ("", "DUMMYDUMMY")
    order = [re.escape(p) for p in sorted(L.words(phrases), key=len, reverse=True)]
    # The word's start is looked at only where the phrase stands.
    steps = [(rf"{U}(?i){p}(?<=\b{p})\b{tail}", new) for p in order]
    return let(c, lambda x: F.when(x.rlike(U + "(?i)" + L.branched(phrases)), _each(x, *steps)).otherwise(x))


def _words(c: Column, abstract: bool) -> Column:
    c = _masked(F.regexp_replace(c, _TAG, " "), L.BOGUS_ABSTRACT if abstract else L.BOGUS_TITLE, abstract)
    steps = []
    if abstract:
        steps.append((U + r"-\d+\.\d+| \d+\.\d+| \d+|-\d+", " number "))
    steps.append((r"(?<=[A-Za-z])\.(?=[A-Z])", ""))
    if abstract:
        steps.append((L.COMPOSITE_UNITS, "units"))
    steps += [
        (U + r"-\d+(?:\s|$)", " "),
        (U + r"(?:^|\s)\d+-", " "),
        (U + r"[^\w\s&]", " "),
        ("s ", " "),
        ("MicroRNA", "MiRNA"),
        ("ATPase", "ATP"),
    ]
    return tokens(_each(c, *steps))


def _codes(words: Column) -> Column:
    """A letter for each word: C in capitals, x not."""
    return F.array_join(F.transform(words, lambda w: F.when(is_all_caps(w), "C").otherwise("x")), "")


def _excluded(words: Column, abstract: bool) -> Column:
    return let(_codes(words), lambda codes: _excluded_by(words, codes, abstract))


def _excluded_by(words: Column, codes: Column, abstract: bool) -> Column:
    n = F.size(words)
    caps = F.length(F.replace(codes, F.lit("x"), F.lit("")))
    long = F.size(F.filter(words, lambda w: F.length(w) > 1))
    share = F.try_divide(caps * 1.0, long)
    out = (n <= 1) | (long == 0) | ((share >= 0.6) & ((n > 2) | (share == 1.0)))
    if abstract:
        return out | codes.rlike("CCCC")
    some = lambda part: F.exists(part, lambda w: F.length(w) >= 5)
    first, last = F.slice(words, 1, 4), F.slice(words, F.greatest(n - 3, F.lit(1)), 4)
    cluster = (codes.rlike("^CCCC") & some(first)) | (codes.rlike("CCCC$") & (caps == 4) & some(last))
    return out | ((n > 4) & cluster)


def _dummies(words: Column, abstract: bool) -> Column:
    roman = L.ROMAN + [r + s for r in L.ROMAN_SUFFIXED for s in ("th", *"abcde")]
    fixed = ["DUMMYDUMMY", *roman, *L.CHROMOSOMES]

    def one(w: Column, i: Column) -> Column:
        big = lambda k: is_all_caps(F.get(words, F.lit(k))) & (F.length(F.get(words, F.lit(k))) > 6)
        opening = (i == 0) & big(0)
        if not abstract:
            both = is_all_caps(F.get(words, F.lit(0))) & is_all_caps(F.get(words, F.lit(1))) & (big(0) | big(1))
            opening = opening | ((i <= 1) & F.coalesce(both, F.lit(False)))
        return F.when(opening | w.isin(fixed) | w.rlike("^[ATCGUp]{6,}$"), "dummy").otherwise(w)

    return F.transform(words, one)


def masked_words(c: Column, abstract: bool) -> Column:
    """Words with masked ones as ``dummy``; empty if the text is left out."""
    none = F.array().cast("array<string>")
    return let(_words(F.coalesce(c, F.lit("")), abstract), lambda w: F.when(_excluded(w, abstract), none).otherwise(_dummies(w, abstract)))


def acronyms(words: Column) -> Column:
    found = F.filter(words, lambda w: (w != "dummy") & is_acronym(w))
    bare = F.transform(found, lambda w: F.when((F.length(w) > 2), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.filter(bare, lambda w: F.length(w) <= 15)


def acronym_columns(words: str, prefix: str) -> dict[str, Column]:
    """Of an array column of masked words: count, word count, density, list."""
    found, n = acronyms(F.col(words)), F.size(words)
    return {
        f"{prefix}_acronym_count": F.size(found).cast("long"),
        f"{prefix}_word_count": n.cast("long"),
        f"{prefix}_acronym_density": F.round(F.coalesce(F.try_divide(F.size(found) * 100.0, n), F.lit(0.0)), 4),
        f"{prefix}_acronyms": F.array_join(found, "|"),
    }
