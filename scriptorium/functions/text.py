"""Text metrics as Column expressions: cleaning, lexicon counts, narrators, sentences."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import lexicons as L

U = "(?U)"


def _each(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of c, which is made once for each row, however often ``body`` names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def tokens(c: Column) -> Column:
    """Words between white space, as Python's split() gives them."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), U + r"\s+", -1), lambda w: w != "")


def squeeze(c: Column) -> Column:
    """White space collapsed and cut off at both ends; single spaces are no match and stay as they are."""
    return F.trim(F.regexp_replace(c, U + r"[\s&&[^ ]]\s*| \s+", " "))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _nfkd_plain(text: pd.Series) -> pd.Series:
    def plain(t: str | None) -> str | None:
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    return text.map(plain)


def sanitize(c: Column, normalize: bool = False) -> Column:
    """Control characters dropped, white space collapsed; NFC first if asked for (that runs in Python)."""
    c = F.coalesce(nfc(c) if normalize else c, F.lit(""))
    return squeeze(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def preprocess(c: Column) -> Column:
    """Structured headings dropped, signs spelled out, brackets tightened."""
    # All headings end with a colon.
    c = F.when(F.contains(c, F.lit(":")), F.regexp_replace(c, "(?i)" + "|".join(L.words(L.HEADINGS)), " ")).otherwise(c)
    # The word's start is looked at only where the word stands.
    c = _each(c, (U + r"ABSTRACT(?<=\bABSTRACT)\b:?", " "), (U + r"(?i)^\s*Abstract\s*[:.]", " "))
    for sign, name in (
        (" = ", " equal to "),
        (" < ", " less than "),
        ("&lt;", " less than "),
        (" > ", " greater than "),
        ("&gt;", " greater than "),
        (" & ", " and "),
        ("&amp;", " and "),
    ):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return squeeze(_each(c, (U + r"\s*(?:±|\+/-+)\s*", " plus or minus "), (U + r"\(\s+", "("), (U + r"\s+\)", ")")))


def word_count(c: Column) -> Column:
    return count(c, U + r"\w+")


def hedging(c: Column) -> Column:
    return count(F.lower(c), U + L.branched(L.HEDGING))


def signposting(c: Column) -> Column:
    return count(F.lower(c), U + L.branched(L.SIGNPOSTING))


def has_narrator(c: Column) -> Column:
    return c.rlike(U + r"\b(?:We|we|Us|us)\b").cast("int")


def hype_words(c: Column) -> Column:
    """Every word of the nine categories, in one scan: no phrase of one category holds a word of another."""
    return F.regexp_extract_all(F.lower(c), F.lit(U + L.branched(",".join(L.HYPE.values()))), F.lit(0))


def hype(found: Column) -> dict[str, Column]:
    """Counts by category of what hype_words() found; a word may be of two."""
    def among(text: str) -> Column:
        pattern = "^(?:" + "|".join(L.words(text)) + ")$"
        return F.size(F.filter(found, lambda w: w.rlike(pattern))).cast("long")

    return {f"hype_{k}": among(v) for k, v in L.HYPE.items()}


def sentence_stops(c: Column) -> Column:
    """Full stops before white space or at the end; 1 at least."""
    last = F.rtrim(c).endswith(".") & ~F.regexp_like(c, F.lit(U + r"\.\s+$"))
    return F.greatest(F.lit(1).cast("long"), count(c, U + r"\.\s") + F.when(last, 1).otherwise(0))


def per_100(n: Column, words: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(n * 100.0, words), F.lit(0.0)), 4)


def looks_like_prose(sentence: Column) -> Column:
    lower = lambda w: F.size(F.filter(w, lambda x: x.rlike(r"^\p{Ll}")))
    return let(tokens(sentence), lambda w: (F.size(w) >= 6) & (lower(w) * 2 > F.size(w)))


def clean_ocr(c: Column, year: Column, cap: int = 350) -> Column:
    """Scanner debris dropped; before 2008 also page headers, and text beyond ``cap`` words at a sentence end."""
    text = squeeze(_each(c, (r"\(cid:\d+\)", " "), (U + r"(?i)^\s*ABSTRACT[:.\s]+", "")))
    return let(text, lambda t: F.when(year < 2008, let(_from_prose(t), lambda body: _capped(body, cap))).otherwise(t))


def _from_prose(text: Column) -> Column:
    """The text; one that begins with a page number from its first sentence of prose."""
    parts = F.split(F.regexp_replace(text, r"^\d{1,4}\s+(?=[A-Z])", ""), r"(?<=[.!?])\s+")

    def rest(parts: Column) -> Column:
        first = F.coalesce(F.array_position(F.transform(parts, looks_like_prose), True), F.lit(0))
        start = F.greatest(first, F.lit(1)).cast("int")
        return let(start, lambda k: F.array_join(F.slice(parts, k, F.greatest(F.size(parts) - k + 1, F.lit(0))), " "))

    return F.when(text.rlike(r"^\d{1,4}\s+(?=[A-Z])"), let(parts, rest)).otherwise(text)


def _capped(body: Column, cap: int) -> Column:
    """A text of more than ``cap`` words up to there, or to the last sentence end before, if that leaves over 100 signs."""

    def cut(head: Column) -> Column:
        at = F.when(head.endswith("."), F.length(head)).otherwise(F.length(head) - F.instr(F.reverse(head), " ."))
        found = head.endswith(".") | (F.instr(head, ". ") > 0)
        return let(at, lambda n: F.when(found & (n - 1 > 100), F.substring(head, F.lit(1), n.cast("int"))).otherwise(head))

    return let(tokens(body), lambda w: F.when(F.size(w) > cap, let(F.array_join(F.slice(w, 1, cap), " "), cut)).otherwise(body))


def best_abstract(abstract: Column, full_text: Column, year: Column) -> Column:
    """The cleaned abstract, or the first 600 words of the full text where it is missing or under 20 words."""
    given = sanitize(abstract)
    given = F.when(F.lower(given).startswith("abstract unavailable"), "").otherwise(given)
    full = tokens(sanitize(full_text))
    short = (F.size(tokens(given)) < 20) & (F.size(full) >= 20)
    return clean_ocr(F.when(short, F.array_join(F.slice(full, 1, 600), " ")).otherwise(given), year)


def parse_authors(names: Column) -> Column:
    """Names of a comma-separated string."""
    return F.filter(F.transform(F.split(F.coalesce(names, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def author_names(given_family: Column) -> Column:
    """Display names of structs (given_name, family_name); blank ones dropped."""
    full = F.transform(given_family, lambda a: F.trim(F.concat_ws(" ", a.given_name, a.family_name)))
    return F.filter(full, lambda x: x != "")


def flip_author(name: Column) -> Column:
    """``Last, First`` to ``First Last``."""
    return F.regexp_replace(F.trim(name), r"^([^,]+),\s*(.+)$", "$2 $1")


def normalize_title(c: Column, ascii_only: bool = False) -> Column:
    """Lower case, no accents, no commands, signs to spaces; without accents in the input no Python runs."""
    c = F.coalesce(c if ascii_only else _nfkd_plain(c), F.lit(""))
    return F.trim(_each(F.lower(c), (r"\\[a-z]+", " "), (r"[^a-z0-9]+", " ")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)) * 1.0, F.size(F.array_union(a, b))), F.lit(0.0))


def topic_text(title: Column, abstract: Column) -> Column:
    """Links, mathematics, commands and markup to spaces; lower case."""
    text = F.concat_ws(" ", title, abstract)
    steps = ((r"https?://\S+", " "), (r"\$[^$]*\$", " "), (r"\\[a-zA-Z]+", " "), (r"[{}\\$^_~]", " "))
    return squeeze(F.lower(_each(text, *steps)))


def arxiv_id(c: Column) -> Column:
    pattern = r"(?i)(?:arxiv[.:]|abs/|pdf/)(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})(v\d+)?"
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def section_name(heading: Column) -> Column:
    """The canonical section of a heading; the first pattern that is found decides."""
    h = F.trim(F.regexp_replace(F.coalesce(heading, F.lit("")), U + r"^(?:\d+|[IVX]+)[.\s]+", ""))
    out = F.lit("other")
    for pattern, name in reversed(L.SECTIONS):
        out = F.when(h.rlike("(?i)" + pattern), name).otherwise(out)
    return out
