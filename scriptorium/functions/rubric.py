"""Rubric features: concrete numbers, claim strength, sentence roles, jargon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.functions.acronyms import is_acronym
from scriptorium.functions.text import U, count, let

ROLE_CODES = dict(zip(L.ROLES, "SGCEI"))


def concrete_number(c: Column) -> Column:
    n = L.NUMBER
    patterns = (rf"(?iu){U}{n}\s*(?:{L.UNITS})(?![a-z])", rf"(?i){U}n\s*=\s*{n}", rf"{U}{n}\s*[×x]\s", rf"{U}[×]\s*{n}")
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def claim_counts(c: Column) -> dict[str, Column]:
    out = {k: count(c, f"(?i){U}" + L.cues(v)) for k, v in L.CLAIMS.items()}
    out["systematic"] = out["systematic"] + count(c, f"(?i){U}" + L.SYSTEMATIC_NUMBERS)
    return out


def claim_strength(counts: dict[str, Column]) -> Column:
    """The class with most cues; ``hedged`` if none has, or several have as many."""
    def strength(n: Column) -> Column:
        best = F.array_max(n)
        winners = F.array_compact(F.array(*[F.when((F.get(n, F.lit(i)) == best) & (best > 0), F.lit(k)) for i, k in enumerate(counts)]))
        return F.when(F.size(winners) == 1, F.get(winners, F.lit(0))).otherwise("hedged")

    return let(F.array(*counts.values()), strength)


def claim_ordinal(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, k in enumerate(L.CLAIMS):
        out = F.when(c == k, i).otherwise(out)
    return out


def split_sentences(c: Column) -> Column:
    """Sentences; a part that ends in an abbreviation is joined to the next."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), U + r"^\s+|\s+$", ""), U + r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", -1)
    joined = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & F.coalesce(F.try_element_at(acc, F.lit(-1)).rlike(U + L.ABBREVIATIONS), F.lit(False)),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), p))),
        )
        .when(p != "", F.concat(acc, F.array(p)))
        .otherwise(acc),
    )
    return F.filter(F.transform(joined, lambda s: F.trim(s)), lambda s: s != "")


def role_cues(sentence: Column) -> Column:
    """Cue counts of a sentence, in role order."""
    return F.array(*[count(sentence, f"(?i){U}" + L.cues(v)) for v in L.ROLES.values()])


def label_roles(sentences: Column) -> Column:
    """One letter a sentence: the role with most cues; ties go to the next in order, no cue to the role before."""
    roles = F.array(*[F.lit(i) for i in range(5)])

    def step(acc: Column, cues: Column) -> Column:
        best = F.array_max(cues)
        tied = F.filter(roles, lambda r: (F.get(cues, r) == best) & (best > 0))
        ahead = F.array_min(F.filter(tied, lambda r: r >= acc.at))
        one = F.when(F.size(tied) == 1, F.get(tied, F.lit(0))).otherwise(F.coalesce(ahead, F.array_max(tied), acc.at))
        return F.struct(one.cast("int").alias("at"), F.concat(acc.seq, F.substring(F.lit("SGCEI"), one + 1, F.lit(1))).alias("seq"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("seq"))
    return F.aggregate(F.transform(sentences, role_cues), start, step, lambda acc: acc.seq)


def collapse(codes: Column) -> Column:
    """Repeats next to each other as one."""
    return F.regexp_replace(codes, r"(.)\1+", "$1")


def template_distance(codes: Column, template: str = "SGCEI") -> Column:
    return F.levenshtein(collapse(codes), F.lit(template))


def jargon_words(c: Column) -> tuple[Column, Column]:
    """Words of two letters or more, and those of them that are no acronyms."""
    words = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z\-]*"), F.lit(0)), lambda w: F.length(w) > 1)
    return words, F.filter(words, lambda w: ~is_acronym(w))


def jargon_density(c: Column, english: list[str]) -> Column:
    """Share of words (two letters or more) that are no acronyms and have no part in the English list."""
    words = F.filter(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z\-]*"), F.lit(0)), lambda w: F.length(w) > 1)
    known = F.array(*map(F.lit, english)) if english else F.array().cast("array<string>")
    odd = lambda w: ~F.arrays_overlap(F.filter(F.split(F.lower(w), "-"), lambda p: p != ""), known)
    n = F.size(F.filter(words, lambda w: ~is_acronym(w) & odd(w)))
    return F.round(F.coalesce(F.try_divide(n * 1.0, F.size(words)), F.lit(0.0)), 4)
