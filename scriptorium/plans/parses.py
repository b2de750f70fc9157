"""Metrics of parsed sentences, over trees that a rule makes of the words of documents.

No parser is at hand, so the rule stands for one: words of a sentence go in
blocks of 3 to 5; the third of each, or the last, is its head and hangs on that
of the block before; lengths and places of words give relations and tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.parses import parsed_metrics
from scriptorium.plans.base import query, table

RELATIONS = ("nsubj", "conj", "dobj", "advcl", "nsubj:pass", "det", "relcl", "pobj", "amod", "punct", "conj")
TAGS = ("NOUN", "VERB", "ADJ", "PRON", "PUNCT", "DET", "PROPN")


def parsed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and tokens of each sentence of a text."""
    at = df.select(id_col, F.explode(F.split(text_col, r"[.!?]", -1)).alias("sentence"))
    words = F.filter(F.split("sentence", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    # Behind a generator no expression that uses the words makes them anew.
    at = at.select(id_col, F.explode(F.array(words)).alias("words"))
    at = at.where(F.size("words") > 0).select("*", F.size("words").alias("n"))
    at = at.withColumn("b", (3 + F.col("n") % 3).cast("int"))

    def placed(w, i):
        k = F.floor(i / F.col("b")).cast("int")
        own = F.least(k * F.col("b") + 2, F.col("n") - 1)
        before = F.when(k > 0, F.least((k - 1) * F.col("b") + 2, F.col("n") - 1)).otherwise(i)
        return F.struct(w.alias("w"), F.when(i != own, own).otherwise(before).cast("int").alias("head"))

    def token(x, i):
        size = F.length(x.w)
        relation = F.when(x.head == i, "ROOT").otherwise(F.get(F.array(*map(F.lit, RELATIONS)), (size * 3 + i) % len(RELATIONS)))
        tag = F.get(F.array(*map(F.lit, TAGS)), (size * 5 + i * i) % len(TAGS))
        return F.struct(x.head.alias("head"), relation.alias("relation"), tag.alias("tag"), x.w.alias("lemma"))

    return at.select(id_col, F.transform(F.transform("words", placed), token).alias("tokens"))


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


@query(
    rf"""
WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]')) AS sentence FROM documents),
w AS (SELECT doc_id, row_number() OVER () AS sid,
  [x for x in string_split_regex(sentence, '[\x20\x09-\x0D]+') if x <> ''] AS words FROM s),
v AS (SELECT doc_id, sid, words, len(words) AS n, 3 + len(words) % 3 AS b FROM w WHERE len(words) > 0),
u AS (SELECT doc_id, sid, n, b, unnest(range(n)) AS i, unnest(words) AS word FROM v),
h AS (SELECT *, i // b AS k, least((i // b) * b + 2, n - 1) AS own, least((i // b - 1) * b + 2, n - 1) AS before FROM u),
t AS (SELECT doc_id, sid, n, i, word, length(word) AS size,
  CASE WHEN i <> own THEN own WHEN k > 0 THEN before ELSE i END AS head FROM h),
tok AS MATERIALIZED (SELECT doc_id, sid, i, head, lower(word) AS lemma,
  CASE WHEN head = i THEN 'ROOT' ELSE {_listed(RELATIONS)}[1 + (size * 3 + i) % {len(RELATIONS)}] END AS rel,
  {_listed(TAGS)}[1 + (size * 5 + i * i) % {len(TAGS)}] AS tag FROM t),
up AS (SELECT sid, i AS j, i AS anc, 0 AS d FROM tok
  UNION ALL SELECT up.sid, j, tok.head, d + 1 FROM up JOIN tok ON tok.sid = up.sid AND tok.i = up.anc WHERE tok.head <> tok.i),
edge AS (SELECT sid, anc AS i, min(j) AS l FROM up GROUP BY sid, anc),
depth AS (SELECT sid, max(d) AS depth FROM up GROUP BY sid),
chain AS (SELECT sid, i, head AS anc FROM tok WHERE rel = 'conj'
  UNION ALL SELECT c.sid, c.i, k.head FROM chain c JOIN tok k ON k.sid = c.sid AND k.i = c.anc WHERE k.rel = 'conj' AND k.head < k.i),
joined AS (SELECT DISTINCT c.sid, c.i FROM chain c JOIN tok k ON k.sid = c.sid AND k.i = c.anc
  WHERE NOT (k.rel = 'conj' AND k.head < k.i) AND k.rel IN ('nsubj','dobj','nsubjpass','pcomp','pobj','dative','appos','attr','ROOT')),
np AS (SELECT tok.sid, tok.i, edge.l, row_number() OVER (PARTITION BY tok.sid ORDER BY tok.i) AS r FROM tok JOIN edge ON edge.sid = tok.sid AND edge.i = tok.i
  LEFT JOIN joined ON joined.sid = tok.sid AND joined.i = tok.i
  WHERE tag IN ('NOUN','PROPN','PRON') AND (rel IN ('nsubj','dobj','nsubjpass','pcomp','pobj','dative','appos','attr','ROOT') OR joined.i IS NOT NULL)),
walk AS (SELECT sid, r, i AS last, 1 AS c FROM np WHERE r = 1
  UNION ALL SELECT n.sid, n.r, CASE WHEN n.l > last THEN n.i ELSE last END, c + (n.l > last)::INT FROM walk JOIN np n ON n.sid = walk.sid AND n.r = walk.r + 1),
chunks AS (SELECT sid, max(c) AS chunks FROM walk GROUP BY sid),
sent AS (SELECT doc_id, sid, count(*) FILTER (rel IN ('advcl','relcl','ccomp','xcomp','acl')) AS clauses,
  max((rel IN ('nsubjpass','auxpass','nsubj:pass','aux:pass'))::INT) AS passive, count(*) FILTER (tag NOT IN ('PUNCT','SPACE')) AS words,
  count(*) FILTER (tag IN ('NOUN','VERB','ADJ','ADV')) AS content FROM tok GROUP BY doc_id, sid),
lem AS (SELECT doc_id, count(DISTINCT lemma) AS lemmas FROM tok WHERE tag IN ('NOUN','VERB','ADJ','ADV') GROUP BY doc_id),
d AS (SELECT doc_id, count(*) AS sentences, sum(depth) AS depth, sum(clauses) AS clauses, sum(passive) AS passive,
  sum(coalesce(chunks, 0)) AS chunks, sum(words) AS words, sum(content) AS content
  FROM sent JOIN depth USING (sid) LEFT JOIN chunks USING (sid) GROUP BY doc_id)
SELECT doc_id, sentences, round(depth / sentences + 1e-9, 6) AS parse_depth, round(clauses / sentences + 1e-9, 6) AS clauses_per_sentence,
  round(passive / sentences + 1e-9, 6) AS passive_rate, round(chunks / greatest(words, 1) + 1e-9, 6) AS np_density,
  round(coalesce(lemmas, 0) / greatest(content, 1) + 1e-9, 6) AS ttr
FROM d LEFT JOIN lem USING (doc_id)"""
)
def parsed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_metrics(parsed(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
