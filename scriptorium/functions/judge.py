"""Strict parsing of judges' answers, evidence checks and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.functions.text import squeeze


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_score(c: Column) -> Column:
    """The number after ``Score:`` that begins with 1 to 5, else the first such number alone."""
    labelled = _found(c, r"(?i)Score:\s*([1-5](?:\.\d+)?)", 1)
    return F.coalesce(labelled, _found(c, r"\b([1-5](?:\.\d+)?)\b", 1)).try_cast("double")


def parse_int_score(c: Column, label: str, low: int, high: int) -> Column:
    """A labelled integer, else the first; null outside the bounds, never clamped."""
    n = F.coalesce(_found(c, rf"(?i){label}:\s*(-?\d+)", 1), _found(c, r"(-?\d+)", 1)).try_cast("int")
    return F.when(n.between(low, high), n)


def parse_verdict(c: Column) -> Column:
    """struct(value, evidence) of the first JSON object; value is null unless a real boolean."""
    text = F.regexp_replace(F.regexp_extract(c, r"(?s)(\{.*)", 1), r"\bTrue\b", "true")
    text = F.regexp_replace(text, r"\bFalse\b", "false")
    got = F.from_json(text, "value boolean, evidence string", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.when(got.value.isNotNull(), F.struct(got.value.alias("value"), F.coalesce(got.evidence, F.lit("")).alias("evidence")))


def verify_evidence(text: Column, evidence: Column) -> Column:
    """Whether the evidence stands in the text, but for case and white space; empty evidence does not."""
    span = F.lower(squeeze(F.coalesce(evidence, F.lit(""))))
    return (span != "") & F.contains(F.lower(squeeze(F.coalesce(text, F.lit("")))), span)


def truthy(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "1")


def parse_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n"), False)


def majority(n_true: Column, n_all: Column) -> Column:
    """More than half, or null for a tie or no vote."""
    return F.when(n_true * 2 != n_all, n_true * 2 > n_all)


def feature_text(sections: Column, captions: Column, urls: Column, feature: str, limit: int = 12000) -> Column:
    """What a judge reads for a feature: its sections, figure 1's caption or the links; everything if none is there."""
    targets = L.TARGETS[feature].split()
    none = F.array().cast("array<string>")
    chunks = []
    if "captions" in targets:
        first = F.filter(captions, lambda c: c.rlike(r"(?i)^\s*fig(?:ure)?\.?\s*1\b"))
        chunks.append(F.coalesce(F.when(F.size(first) > 0, first).otherwise(F.slice(captions, 1, 1)), none))
    if "urls" in targets:
        links = F.concat(F.lit("Links found in the paper: "), F.array_join(urls, " "))
        chunks.append(F.when(F.size(urls) > 0, F.array(links)).otherwise(none))
    wanted = [t for t in targets if t not in ("captions", "urls")]
    if wanted:
        own = F.filter(sections, lambda s: s.normalized.isin(wanted) & (F.coalesce(s.text, F.lit("")) != ""))
        head = lambda s: F.coalesce(F.nullif(s.heading, F.lit("")), s.normalized)
        chunks.append(F.coalesce(F.transform(own, lambda s: F.concat(F.lit("["), head(s), F.lit("]\n"), s.text)), none))
    found = F.concat(*chunks)
    whole = F.transform(sections, lambda s: F.coalesce(s.text, F.lit("")))
    return F.substring(F.array_join(F.when(F.size(found) > 0, found).otherwise(whole), "\n\n"), 1, limit)


def build_prompt(template: str, question: Column | str, text: Column) -> Column:
    """A template with {QUESTION} and {TEXT} filled in."""
    filled = F.replace(F.lit(template), F.lit("{QUESTION}"), F.lit(question) if isinstance(question, str) else question)
    return F.replace(filled, F.lit("{TEXT}"), text)


def noun_chains(tags: Column) -> dict[str, Column]:
    """Counts over an array of part-of-speech tags: runs of three nouns (apart), nouns, verbs, numbers."""
    line = F.array_join(tags, "/")
    out = {"noun_chunks3": F.regexp_count(line, F.lit(r"(?<![A-Z])NOUN/NOUN/NOUN(?![A-Z])"))}
    out |= {f"{t.lower()}_count": F.size(F.filter(tags, _is(t))) for t in ("NOUN", "VERB", "NUM")}
    return out


def _is(tag: str):
    return lambda x: x == tag


def type_token_ratio(lemmas: Column) -> Column:
    return F.round(F.try_divide(F.size(F.array_distinct(lemmas)) * 1.0, F.size(lemmas)), 4)


def tree_depth(heads: Column) -> Column:
    """Longest way to a root in an array of head places; a root is its own head. Ways double in each round."""
    steps = F.transform(heads, lambda h, i: F.when(h == i, 0).otherwise(1))
    start = F.struct(heads.cast("array<int>").alias("at"), steps.cast("array<int>").alias("n"))

    def double(acc: Column, _: Column) -> Column:
        at = F.transform(acc.at, lambda k: F.get(acc.at, k))
        n = F.transform(acc.n, lambda m, i: m + F.get(acc.n, F.get(acc.at, i)))
        return F.struct(at.alias("at"), n.alias("n"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(heads) + 1)).cast("int"))
    got = F.aggregate(rounds, start, double, lambda acc: F.least(F.array_max(acc.n), F.size(heads)))
    return F.when(F.size(heads) > 0, got).otherwise(0)
