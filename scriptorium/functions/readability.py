"""Readability formulas over one set of counts.

Syllables are groups of vowels, less a silent final ``e`` (not after ``l``), one at
least; words
are letters with inner apostrophes or hyphens; sentences end in ``.``, ``!`` or
``?``. These are published formulas on documented counts, not any library's
rounding (halves go up; noise under 1e-9 is ignored). Dale-Chall and Spache take the list of easy words as an argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens


def syllables(w: Column) -> Column:
    low = F.lower(w)
    silent = low.rlike("[^aeiouyl]e$").cast("int")
    return F.greatest(F.regexp_count(low, F.lit("[aeiouy]+")) - silent, F.lit(1))


def counts(c: Column, easy: list[str] | None = None) -> dict[str, Column]:
    """Columns to be selected before scores() is applied: words, sentences, syllables and so on."""
    words = F.regexp_extract_all(c, F.lit(r"\p{L}+(?:['\-]\p{L}+)*"), F.lit(0))
    return {
        "words": words,
        "syl": F.transform(words, syllables),
        "sentences": F.greatest(F.regexp_count(c, F.lit(r"[.!?]+(?:\s|$)")), F.lit(1)),
        "n_split": F.size(tokens(c)),
        "easy": F.size(F.filter(words, lambda w: F.lower(w).isin(easy))) if easy else F.lit(0),
    }


def scores(n_min: int = 10) -> dict[str, Column]:
    """Metrics of the columns that counts() made; all null for a text under ``n_min`` words."""
    W, S = F.size("words") * 1.0, F.col("sentences") * 1.0
    at_least = lambda k: F.size(F.filter("syl", lambda s: s >= k)) * 1.0
    Y = F.aggregate("syl", F.lit(0), lambda a, s: a + s) * 1.0
    letters = F.length(F.regexp_replace(F.array_join("words", ""), r"\P{L}", "")) * 1.0
    P, mono = at_least(3), W - at_least(2)
    long = F.size(F.filter("words", lambda w: F.length(w) > 6)) * 1.0
    hard = W - F.col("easy")
    first = F.slice("syl", 1, 100)
    linsear = (F.size(first) + 2.0 * F.size(F.filter(first, lambda s: s >= 3))) / (S * F.size(first) / W)
    pct = 100.0 * hard / W
    out = {
        "word_count": W,
        "sentence_count": S,
        "syllable_count": Y,
        "polysyllable_count": P,
        "monosyllable_count": mono,
        "difficult_words": hard,
        "avg_sentence_length": W / S,
        "avg_syllables_per_word": Y / W,
        "flesch_ease": 206.835 - 1.015 * W / S - 84.6 * Y / W,
        "flesch_kincaid": 0.39 * W / S + 11.8 * Y / W - 15.59,
        "gunning_fog": 0.4 * (W / S + 100.0 * P / W),
        "smog": 1.043 * F.sqrt(30.0 * P / S) + 3.1291,
        "dale_chall": 0.1579 * pct + 0.0496 * W / S + F.when(pct > 5, 3.6365).otherwise(0.0),
        "spache": 0.141 * W / S + 0.086 * pct + 0.839,
        "coleman_liau": 0.0588 * 100.0 * letters / W - 0.296 * 100.0 * S / W - 15.8,
        "ari": 4.71 * letters / W + 0.5 * W / S - 21.43,
        "linsear_write": F.when(linsear > 20, linsear / 2).otherwise((linsear - 2) / 2),
        "lix": W / S + 100.0 * long / W,
        "rix": long / S,
        "forcast": 20.0 - 15.0 * mono / F.col("n_split"),
        "powers_sumner_kearl": 0.0778 * W / S + 0.0455 * 100.0 * Y / W - 2.2029,
    }
    enough = (F.col("n_split") >= n_min) & (F.size("words") > 0)
    return {k: F.when(enough, F.round(v + 1e-9, 3)) for k, v in out.items()}


def listed_scores(words: Column, sentences: Column, difficult: Column) -> dict[str, Column]:
    """The two formulas that need a list of easy words, of counts; null without words."""
    pct, length = F.try_divide(100.0 * difficult, words), F.when(words > 0, words / sentences)
    out = {
        "dale_chall": 0.1579 * pct + 0.0496 * length + F.when(pct > 5, 3.6365).otherwise(0.0),
        "spache": 0.141 * length + 0.086 * pct + 0.839,
    }
    return {k: F.round(v + 1e-9, 3) for k, v in out.items()}
