"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected, sorted, merged where neighbours
have the same role, and concatenated into one string in a marked-turn template::

    <|im_start|>role\\ntext<|im_part|>text<|im_end|>\\n

``<|im_part|>`` stands between the texts of merged turns, so nothing is lost.
Inside roles and texts a backslash becomes ``\\b``, ``<|`` becomes ``<\\p`` and,
in roles, a line break becomes ``\\n``; each escape is a backslash and one letter,
so unescaping is exact.

Cases: null text or role is empty; turns are sorted by (turn, role, text) with
null turns first, so ties and repeated rows have one order and all stay; rows
with a null conversation form one conversation; other columns are not read; an
empty table gives an empty result. A conversation becomes one string, so its
turns meet in one task: that is the feature's own bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END = "<|im_start|>", "<|im_part|>", "<|im_end|>\n"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, role: bool = False) -> Column:
    c = _swap(_swap(c, "\\", "\\b"), "<|", "<\\p")
    return _swap(c, "\n", "\\n") if role else c


def unescape(c: Column, role: bool = False) -> Column:
    if role:
        c = _swap(c, "\\n", "\n")
    return _swap(_swap(c, "\\p", "|"), "\\b", "\\")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _segments(block: Column, loss_roles: tuple[str, ...]) -> Column:
    off, on = F.lit(False), block.role.isin(*loss_roles)
    texts = F.transform(
        block.parts,
        lambda p, i: F.when(i == 0, F.array(_segment(escape(p), on))).otherwise(
            F.array(_segment(F.lit(PART), off), _segment(escape(p), on))
        ),
    )
    head = F.array(_segment(F.concat(F.lit(START), escape(block.role, True), F.lit("\n")), off))
    return F.concat(head, F.flatten(texts), F.array(_segment(F.lit(END), off)))


def format_conversations(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, segments (text, loss; their texts joined are formatted), n_blocks."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = df.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    size = F.size("turns")
    starts = F.filter(
        F.sequence(F.lit(1), size),
        lambda i: (i == 1) | (F.element_at("turns", i).role != F.element_at("turns", F.greatest(i - 1, F.lit(1))).role),
    )
    got = got.withColumn("starts", starts)
    after = lambda k: F.when(k + 1 < F.size("starts"), F.element_at("starts", k + 2)).otherwise(size + 1)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.element_at("turns", s).role.alias("role"),
            F.transform(F.slice("turns", s, after(k) - s), lambda t: t.text).alias("parts"),
        ),
    )
    got = got.withColumn("blocks", blocks)
    got = got.withColumn("segments", F.flatten(F.transform("blocks", lambda b: _segments(b, loss_roles))))
    formatted = F.array_join(F.transform("segments", lambda s: s.text), "")
    return got.select("conv_id", formatted.alias("formatted"), "segments", F.size("blocks").cast("long").alias("n_blocks"))


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted string."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        at = F.instr(body, "\n")
        role = unescape(F.substring(body, F.lit(1), at - 1), True)
        parts = F.split(F.substring(body, at + 1, F.length(body)), r"<\|im_part\|>", -1)
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
