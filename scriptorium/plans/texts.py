"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import acronyms as A
from scriptorium.functions import judge as J
from scriptorium.functions import lexicons as L
from scriptorium.functions import readability as R
from scriptorium.functions import rubric as B
from scriptorium.functions import text as T
from scriptorium.plans.base import PAPERS, count_sql, papers, plain_letters, query, table, text_sql

#: preprocess() for texts in which only ASCII white space stands.
PRE = "text"
for _p, _n, _f in (
    ("|".join(L.words(L.HEADINGS)), " ", "gi"),
    (r"\bABSTRACT\b:?", " ", "g"),
    (r"^\s*Abstract\s*[:.]", " ", "gi"),
    (" = ", " equal to ", "g"),
    (" < ", " less than ", "g"),
    ("&lt;", " less than ", "g"),
    (" > ", " greater than ", "g"),
    ("&gt;", " greater than ", "g"),
    (" & ", " and ", "g"),
    ("&amp;", " and ", "g"),
    (r"\s*±\s*|\s*\+/-+\s*", " plus or minus ", "g"),
    (r"\(\s+", "(", "g"),
    (r"\s+\)", ")", "g"),
    (r"\s+", " ", "g"),
):
    PRE = f"regexp_replace({PRE}, {text_sql(_p)}, {text_sql(_n)}, '{_f}')"
PRE = f"trim({PRE})"
#: The texts are invented and hold no cue words, so most get a sentence that does; the rest stay as they are.
CUED = """CASE paper_id % 7
  WHEN 0 THEN 'However, we may possibly need further  studies of this novel, robust and user-friendly result. '
  WHEN 1 THEN 'Firstly, it seems critical. We believe that such extremely important, unprecedented work is ( perhaps ) next. '
  WHEN 2 THEN 'RESULTS: They show us a long standing multi-disciplinary & critical problem: gains of 12% < 40 points. '
  WHEN 3 THEN 'Methods: n = 40 samples, 3 × 4 GB, accuracy +/- 2 percent, likely a rapidly growing, vast and ideal field. '
  WHEN 4 THEN 'ABSTRACT: moreover, in theory, largely critical; nevertheless it could be outstanding, alarming and exceptional. '
  ELSE '' END || text"""
ROWS = f"""WITH p AS (SELECT paper_id, venue, year, {CUED} AS text FROM ({PAPERS})), c AS (SELECT paper_id, venue, year, text, {PRE} AS clean FROM p),
l AS (SELECT *, {plain_letters('clean')} AS letters, {plain_letters('lower(clean)')} AS low,
  {count_sql('clean', '[\\p{L}\\p{M}\\p{N}_]+')} AS n_words FROM c)"""


def _per_100(n: str, words: str = "n_words") -> str:
    return f"round(CASE WHEN {words} = 0 THEN 0.0 ELSE {n} * 100.0 / {words} END, 4)"


def _rows(spark, sf_dir):
    at = papers(spark, sf_dir).withColumn("text", F.expr(CUED))
    at = at.withColumn("clean", T.preprocess(F.col("text")))
    return at.withColumn("n_words", T.word_count(F.col("clean")))


_HEDGE, _SIGN = count_sql("low", L.alternation(L.HEDGING)), count_sql("low", L.alternation(L.SIGNPOSTING))


@query(f"""{ROWS}, r AS (SELECT year, {_per_100(_HEDGE)} AS h, {_per_100(_SIGN)} AS s, n_words FROM l)
SELECT year, round(avg(h), 6) AS hedging_mean, round(stddev_samp(h), 6) AS hedging_std, count(h) AS hedging_count,
  round(avg(s), 6) AS signposting_mean, round(stddev_samp(s), 6) AS signposting_std, count(s) AS signposting_count,
  round(avg(n_words), 6) AS words_mean FROM r GROUP BY year""")
def hedging_yearly(spark, sf_dir):
    """Hedging and signposting per 100 words by year: mean, deviation, count."""
    c = F.col("clean")
    at = _rows(spark, sf_dir).select("year", "n_words", T.per_100(T.hedging(c), F.col("n_words")).alias("h"), T.per_100(T.signposting(c), F.col("n_words")).alias("s"))
    aggs = []
    for k, name in (("h", "hedging"), ("s", "signposting")):
        aggs += [F.round(F.avg(k), 6).alias(f"{name}_mean"), F.round(F.stddev_samp(k), 6).alias(f"{name}_std"), F.count(k).alias(f"{name}_count")]
    return at.groupBy("year").agg(*aggs, F.round(F.avg("n_words"), 6).alias("words_mean"))


@query(f"{ROWS} SELECT paper_id, venue, year, n_words, {_HEDGE} AS hedging_count, {_per_100(_HEDGE)} AS hedging_per_100 FROM l")
def hedging_rows(spark, sf_dir):
    n = T.hedging(F.col("clean"))
    return _rows(spark, sf_dir).select("paper_id", "venue", "year", "n_words", n.alias("hedging_count"), T.per_100(n, F.col("n_words")).alias("hedging_per_100"))


@query(f"{ROWS} SELECT paper_id, venue, year, n_words, {_SIGN} AS signposting_count, {_per_100(_SIGN)} AS signposting_per_100 FROM l")
def signposting_rows(spark, sf_dir):
    n = T.signposting(F.col("clean"))
    return _rows(spark, sf_dir).select("paper_id", "venue", "year", "n_words", n.alias("signposting_count"), T.per_100(n, F.col("n_words")).alias("signposting_per_100"))


_HYPE = {f"hype_{k}": count_sql("low", L.alternation(v)) for k, v in L.HYPE.items()}


@query(f"""{ROWS}, h AS (SELECT paper_id, n_words, {', '.join(f'{v} AS {k}' for k, v in _HYPE.items())} FROM l),
t AS (SELECT *, {' + '.join(_HYPE)} AS hype_total FROM h)
SELECT *, {', '.join(f'round({k} * 100.0 / greatest(n_words, 1), 4) AS {k}_per_100' for k in (*_HYPE, 'hype_total'))} FROM t""")
def hype_rows(spark, sf_dir):
    """Nine categories of sensational words, their total, and each per 100 words."""
    at = _rows(spark, sf_dir).withColumn("found", T.hype_words(F.col("clean")))
    at = at.select("paper_id", "n_words", *[n.alias(k) for k, n in T.hype(F.col("found")).items()])
    at = at.withColumn("hype_total", sum((F.col(k) for k in list(_HYPE)[1:]), F.col(list(_HYPE)[0])))
    one = F.greatest(F.col("n_words"), F.lit(1))
    return at.select("*", *[F.round(F.col(k) * 100.0 / one, 4).alias(f"{k}_per_100") for k in (*_HYPE, "hype_total")])


@query(f"{ROWS} SELECT paper_id, venue, year, n_words, regexp_matches(letters, '\\b(?:We|we|Us|us)\\b')::INT AS has_narrator FROM l")
def narration_rows(spark, sf_dir):
    return _rows(spark, sf_dir).select("paper_id", "venue", "year", "n_words", T.has_narrator(F.col("clean")).alias("has_narrator"))


@query(rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents),
s AS (SELECT doc_id, clean, list_filter(string_split(split_part(clean, '. ', 1), ' '), lambda w: w <> '') AS w FROM c)
SELECT doc_id, clean, (len(w) >= 6 AND 2 * len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Ll}}'))) > len(w)) AS prose FROM s""")
def clean_text(spark, sf_dir):
    """Sanitised text, and whether its first sentence reads as prose."""
    at = table(spark, sf_dir, "documents").select("doc_id", T.sanitize(F.col("text")).alias("clean"))
    return at.withColumn("prose", T.looks_like_prose(F.split("clean", r"\. ", 2)[0]))


_OCR = rf"""WITH t AS (SELECT paper_id, year, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN paper_id % 3 = 0 THEN '12 ' || text ELSE text END, '\(cid:\d+\)', ' ', 'g'), '(?i)^\s*ABSTRACT[:.\s]+', ''), '\s+', ' ', 'g')) AS text FROM ({PAPERS})),
p AS (SELECT *, string_split(regexp_replace(regexp_replace(text, '^\d{{1,4}}\s+([A-Z])', '\1'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM t),
f AS (SELECT *, greatest(coalesce(list_position(list_transform(parts, lambda s: len(list_filter(string_split(s, ' '), lambda x: x <> '')) >= 6
  AND 2 * len(list_filter(string_split(s, ' '), lambda x: regexp_matches(x, '^\p{{Ll}}'))) > len(list_filter(string_split(s, ' '), lambda x: x <> ''))), true), 0), 1) AS first FROM p),
b AS (SELECT *, CASE WHEN regexp_matches(text, '^\d{{1,4}}\s+[A-Z]') THEN array_to_string(parts[first:], ' ') ELSE text END AS body FROM f),
w AS (SELECT *, list_filter(string_split(body, ' '), lambda x: x <> '') AS words FROM b),
h AS (SELECT *, array_to_string(words[1:350], ' ') AS head FROM w),
c AS (SELECT *, CASE WHEN head LIKE '%.' THEN length(head) WHEN head LIKE '%. %' THEN length(head) - strpos(reverse(head), ' .') ELSE 0 END AS stop FROM h)
SELECT paper_id, year, CASE WHEN year >= 2008 THEN text WHEN len(words) <= 350 THEN body WHEN stop > 101 THEN substr(head, 1, stop) ELSE head END AS clean FROM c"""


@query(_OCR)
def clean_ocr_rows(spark, sf_dir):
    """Scanner debris off each text, with page numbers put before some."""
    p = papers(spark, sf_dir)
    raw = F.when(F.col("paper_id") % 3 == 0, F.concat(F.lit("12 "), F.col("text"))).otherwise(F.col("text"))
    return p.select("paper_id", "year", T.clean_ocr(raw, F.col("year")).alias("clean"))


@query(rf"""WITH a AS (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS abs,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS whole FROM documents),
w AS (SELECT *, list_filter(string_split(abs, ' '), lambda x: x <> '') AS aw, list_filter(string_split(whole, ' '), lambda x: x <> '') AS fw FROM a),
b AS (SELECT doc_id, CASE WHEN len(aw) < 20 AND len(fw) >= 20 THEN array_to_string(fw[1:600], ' ') ELSE abs END AS abstract FROM w)
SELECT doc_id, abstract, len(list_filter(string_split(abstract, ' '), lambda x: x <> '')) >= 10 AS long_enough FROM b""")
def best_abstract_fallback(spark, sf_dir):
    """The first line as abstract, the text as its fallback; and the short-text guard."""
    d = table(spark, sf_dir, "documents")
    line = F.split("text", "\n", 2)[0]
    at = d.select("doc_id", T.best_abstract(line, F.col("text"), F.lit(2010)).alias("abstract"))
    return at.withColumn("long_enough", F.size(T.tokens(F.col("abstract"))) >= 10)


@query()
def acronym_rows(spark, sf_dir):
    """Acronyms of the first line as title and of the text as abstract."""
    p = papers(spark, sf_dir)
    at = p.select("paper_id", "venue", "year", A.masked_words(F.split("text", "\n", 2)[0], False).alias("t"), A.masked_words(F.col("text"), True).alias("a"))
    cols = A.acronym_columns("t", "title") | A.acronym_columns("a", "abstract")
    return at.select("paper_id", "venue", "year", *[c.alias(k) for k, c in cols.items()])


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT doc_id, len(words) AS n, list_filter(words, lambda x:
  length(regexp_replace(x, '\P{Lu}', '', 'g')) >= length(regexp_replace(x, '[^\p{Ll}\p{Nd}]', '', 'g'))
  AND length(regexp_replace(x, '\P{Lu}', '', 'g')) >= 2) AS found FROM w),
t AS (SELECT doc_id, n, list_filter(list_transform(found, lambda x: CASE WHEN length(x) > 2 THEN regexp_replace(x, 's$', '') ELSE x END), lambda x: length(x) <= 15) AS found FROM f)
SELECT doc_id, n AS n_words, len(found) AS n_acronyms, array_to_string(found, '|') AS acronyms FROM t""")
def acronym_tokens(spark, sf_dir):
    """The letter rule alone, on the bare words of a text."""
    at = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("words"))
    at = at.withColumn("found", A.acronyms(F.col("words")))
    return at.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size("found").cast("long").alias("n_acronyms"), F.array_join("found", "|").alias("acronyms"))


_N = L.NUMBER
_UNITS_SQL = L.UNITS.replace("[BMK]\\b", "[BMK]\\b")


@query(rf"""WITH t AS (SELECT paper_id, {CUED} AS text FROM ({PAPERS}))
SELECT paper_id, (regexp_matches(text, {text_sql(f'(?i){_N}' + chr(92) + f's*(?:{_UNITS_SQL})(?:[^a-z]|$)')})
  OR regexp_matches(text, '(?i)n\s*=\s*\d+') OR regexp_matches(text, '\d\s*[×x]\s') OR regexp_matches(text, '[×]\s*\d')) AS concrete
FROM t""")
def concrete_number(spark, sf_dir):
    """Whether a text names a number with a unit; some texts get such a sentence before them."""
    at = papers(spark, sf_dir).withColumn("text", F.expr(CUED))
    return at.select("paper_id", B.concrete_number(F.col("text")).alias("concrete"))


_CLAIMS = {k: count_sql("x", "(?i)" + L.cues(v)) for k, v in L.CLAIMS.items()}
_CLAIMS["systematic"] += " + " + count_sql("x", "(?i)" + L.SYSTEMATIC_NUMBERS)
_PROOF = "CASE WHEN doc_id % 4 = 0 THEN 'We prove a lower bound. ' WHEN doc_id % 4 = 1 THEN 'It may hold across 13 models on 7 datasets. ' ELSE '' END || text"


@query(f"""WITH t AS (SELECT doc_id, {plain_letters(_PROOF)} AS x FROM documents),
c AS (SELECT doc_id, {', '.join(f'{v} AS n_{k}' for k, v in _CLAIMS.items())} FROM t),
b AS (SELECT *, greatest(n_existence, n_hedged, n_systematic, n_guarantee) AS best FROM c)
SELECT doc_id, n_existence, n_hedged, n_systematic, n_guarantee,
  CASE WHEN best = 0 OR (n_existence = best)::INT + (n_hedged = best)::INT + (n_systematic = best)::INT + (n_guarantee = best)::INT > 1 THEN 'hedged'
    WHEN n_existence = best THEN 'existence' WHEN n_hedged = best THEN 'hedged' WHEN n_systematic = best THEN 'systematic' ELSE 'guarantee' END AS claim_strength,
  CASE claim_strength WHEN 'existence' THEN 0 WHEN 'hedged' THEN 1 WHEN 'systematic' THEN 2 ELSE 3 END AS claim_ordinal FROM b""")
def claim_strength(spark, sf_dir):
    """Cue counts and class of claims; some texts get a claim put before them."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    before = F.when(k == 0, "We prove a lower bound. ").when(k == 1, "It may hold across 13 models on 7 datasets. ").otherwise("")
    counts = B.claim_counts(F.concat(before, F.col("text")))
    at = d.select("doc_id", *[n.alias(f"n_{c}") for c, n in counts.items()])
    at = at.withColumn("claim_strength", B.claim_strength({c: F.col(f"n_{c}") for c in counts}))
    return at.withColumn("claim_ordinal", B.claim_ordinal(F.col("claim_strength")))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s,
  greatest(1, len(regexp_extract_all(text, '\.\s')) + CASE WHEN regexp_matches(text, '\.$') THEN 1 ELSE 0 END) AS stops FROM documents)
SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x))) AS longest, stops FROM s""")
def sentence_split(spark, sf_dir):
    at = table(spark, sf_dir, "documents").select("doc_id", B.split_sentences(F.col("text")).alias("s"), T.sentence_stops(F.col("text")).alias("stops"))
    return at.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"), "stops")


@query()
def role_sequence_dist(spark, sf_dir):
    """Roles of the sentences of each text and their distance to the template."""
    at = papers(spark, sf_dir).select("paper_id", B.label_roles(B.split_sentences(F.col("text"))).alias("roles"))
    return at.withColumn("role_sequence_dist", B.template_distance(F.col("roles")))


@query("""WITH r AS (SELECT conv_id, turn, substr(upper(role), 1, 1) AS c, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role FROM conversations),
s AS (SELECT conv_id, string_agg(c, '' ORDER BY turn) AS roles, coalesce(string_agg(c, '' ORDER BY turn) FILTER (WHERE before IS NULL OR before <> role), '') AS runs FROM r GROUP BY conv_id)
SELECT conv_id, roles, runs, levenshtein(runs, 'SUAUA')::INT AS dist FROM s""")
def role_runs(spark, sf_dir):
    """Roles of a conversation's turns, repeats collapsed, and their distance to a template."""
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", F.substring(F.upper("role"), 1, 1).alias("c"))))
    at = c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t.c), "").alias("roles"))
    return at.select("conv_id", "roles", B.collapse(F.col("roles")).alias("runs"), B.template_distance(F.col("roles"), "SUAUA").alias("dist"))


_ENGLISH = "the of and to in is that for with was this on be are as by it from at he an or re".split()


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z\-]*'), lambda x: length(x) > 1) AS w FROM documents),
j AS (SELECT doc_id, w, list_filter(w, lambda x: NOT (length(regexp_replace(x, '[^A-Z]', '', 'g')) >= length(regexp_replace(x, '[^a-z]', '', 'g')) AND length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2)
  AND len(list_intersect(string_split(lower(x), '-'), {_ENGLISH})) = 0) AS odd FROM w)
SELECT doc_id, len(w) AS n_tokens, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(odd) * 1.0 / len(w) END, 4) AS jargon_density FROM j""")
def jargon_density(spark, sf_dir):
    c = F.col("text")
    n = F.size(F.filter(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z\-]*"), F.lit(0)), lambda w: F.length(w) > 1))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_tokens"), B.jargon_density(c, _ENGLISH).alias("jargon_density"))


@query(rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\p{{L}}+(?:[''\-]\p{{L}}+)*') AS words, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s|$)'))) * 1.0 AS S,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_split FROM documents),
y AS (SELECT *, list_transform(words, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN regexp_matches(lower(x), '[^aeiouyl]e$') THEN 1 ELSE 0 END)) AS syl FROM w),
c AS (SELECT doc_id, n_split, len(words) * 1.0 AS W, S, list_sum(syl) * 1.0 AS Y, len(list_filter(syl, lambda x: x >= 3)) * 1.0 AS P, len(list_filter(syl, lambda x: x < 2)) * 1.0 AS M,
  length(regexp_replace(array_to_string(words, ''), '\P{{L}}', '', 'g')) * 1.0 AS C, len(list_filter(words, lambda x: length(x) > 6)) * 1.0 AS G,
  len(list_filter(words, lambda x: lower(x) IN {tuple(_ENGLISH)})) * 1.0 AS E, syl[1:100] AS f FROM y),
l AS (SELECT *, (len(f) + 2.0 * len(list_filter(f, lambda x: x >= 3))) / (S * len(f) / W) AS lin, 100.0 * (W - E) / W AS pct FROM c WHERE n_split >= 10 AND W > 0)
SELECT doc_id, round(W + 1e-9, 3) AS word_count, round(S + 1e-9, 3) AS sentence_count, round(Y + 1e-9, 3) AS syllable_count, round(P + 1e-9, 3) AS polysyllable_count, round(M + 1e-9, 3) AS monosyllable_count, round(W - E + 1e-9, 3) AS difficult_words,
  round(W / S + 1e-9, 3) AS avg_sentence_length, round(Y / W + 1e-9, 3) AS avg_syllables_per_word, round(206.835 - 1.015 * W / S - 84.6 * Y / W + 1e-9, 3) AS flesch_ease, round(0.39 * W / S + 11.8 * Y / W - 15.59 + 1e-9, 3) AS flesch_kincaid,
  round(0.4 * (W / S + 100.0 * P / W) + 1e-9, 3) AS gunning_fog, round(1.043 * sqrt(30.0 * P / S) + 3.1291 + 1e-9, 3) AS smog, round(0.1579 * pct + 0.0496 * W / S + CASE WHEN pct > 5 THEN 3.6365 ELSE 0.0 END + 1e-9, 3) AS dale_chall,
  round(0.141 * W / S + 0.086 * pct + 0.839 + 1e-9, 3) AS spache, round(0.0588 * 100.0 * C / W - 0.296 * 100.0 * S / W - 15.8 + 1e-9, 3) AS coleman_liau, round(4.71 * C / W + 0.5 * W / S - 21.43 + 1e-9, 3) AS ari,
  round(CASE WHEN lin > 20 THEN lin / 2 ELSE (lin - 2) / 2 END + 1e-9, 3) AS linsear_write, round(W / S + 100.0 * G / W + 1e-9, 3) AS lix, round(G / S + 1e-9, 3) AS rix, round(20.0 - 15.0 * M / n_split + 1e-9, 3) AS forcast,
  round(0.0778 * W / S + 0.0455 * 100.0 * Y / W - 2.2029 + 1e-9, 3) AS powers_sumner_kearl FROM l
UNION ALL BY NAME SELECT doc_id FROM c WHERE NOT (n_split >= 10 AND W > 0)""".replace(" W ", " ww ").replace("(W ", "(ww ").replace(" W)", " ww)").replace("/ W", "/ ww").replace("AS W,", "AS ww,").replace("(W,", "(ww,"))
def readability_rows(spark, sf_dir):
    """All readability formulas; null for texts under 10 words."""
    d = table(spark, sf_dir, "documents")
    at = d.select("doc_id", *[c.alias(k) for k, c in R.counts(F.col("text"), _ENGLISH).items() if k != "syl"])
    at = at.withColumn("syl", F.transform("words", R.syllables))
    return at.select("doc_id", *[c.alias(k) for k, c in R.scores().items()])


#: Words of ASCII letters that stand in two documents or more: the list that the two queries below read.
LISTED = "SELECT word FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents) GROUP BY word HAVING count(*) >= 2"


def _word_list(spark, sf_dir):
    """The list as a table of lines, read back as any word list is, comments and all."""
    from scriptorium.sources.scratch import new_path
    from scriptorium.sources.tables import read_word_list

    d = table(spark, sf_dir, "documents")
    words = d.select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower))).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.col("word").alias("value"))
    path = new_path(spark, "word-list")
    words.unionByName(spark.sql("VALUES ('# a comment'), ('') AS t(value)")).write.text(path)
    return read_word_list(spark, path)


@query(rf"""WITH e AS ({LISTED}),
w AS (SELECT doc_id, regexp_extract_all(text, '\p{{L}}+(?:[''\-]\p{{L}}+)*') AS words, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s|$)'))) * 1.0 AS s FROM documents),
u AS (SELECT doc_id, lower(unnest(words)) AS word FROM w), k AS (SELECT doc_id, count(*) AS n_listed FROM u SEMI JOIN e USING (word) GROUP BY doc_id),
c AS (SELECT doc_id, len(words) * 1.0 AS n, s, coalesce(n_listed, 0) AS n_listed FROM w LEFT JOIN k USING (doc_id)),
p AS (SELECT *, CASE WHEN n > 0 THEN 100.0 * (n - n_listed) / n END AS pct FROM c)
SELECT doc_id, n::BIGINT AS n_words, n_listed::BIGINT AS n_listed, round(0.1579 * pct + 0.0496 * n / s + CASE WHEN pct > 5 THEN 3.6365 ELSE 0.0 END + 1e-9, 3) AS dale_chall,
  round(0.141 * n / s + 0.086 * pct + 0.839 + 1e-9, 3) AS spache FROM p""")
def dictionary_readability(spark, sf_dir):
    """Dale-Chall and Spache with a list of thousands of easy words, which is a table."""
    from scriptorium.operators.dictionary import with_listed

    d = table(spark, sf_dir, "documents")
    c = R.counts(F.col("text"))
    at = with_listed(d, "doc_id", c["words"], _word_list(spark, sf_dir), {"n_words": F.size(c["words"]).cast("long"), "s": c["sentences"]})
    out = R.listed_scores(F.col("n_words"), F.col("s"), F.col("n_words") - F.col("n_listed"))
    return at.select("doc_id", "n_words", "n_listed", *[x.alias(k) for k, x in out.items()])


@query(rf"""WITH e AS ({LISTED}), w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z\-]*'), lambda x: length(x) > 1) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM w),
o AS (SELECT * FROM t WHERE NOT (length(regexp_replace(t, '[^A-Z]', '', 'g')) >= length(regexp_replace(t, '[^a-z]', '', 'g')) AND length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 2)),
p AS (SELECT doc_id, i, unnest(string_split(lower(t), '-')) AS word FROM o), k AS (SELECT doc_id, count(DISTINCT i) AS known FROM p SEMI JOIN e USING (word) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS odd FROM o GROUP BY doc_id)
SELECT doc_id, len(w) AS n_tokens, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE (coalesce(odd, 0) - coalesce(known, 0)) * 1.0 / len(w) END, 4) AS jargon_density
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""")
def dictionary_jargon(spark, sf_dir):
    """Jargon density with a list of thousands of words, which is a table."""
    from scriptorium.operators.dictionary import with_listed

    words, plain = B.jargon_words(F.col("text"))
    at = with_listed(table(spark, sf_dir, "documents"), "doc_id", plain, _word_list(spark, sf_dir), {"n_tokens": F.size(words).cast("long"), "n_plain": F.size(plain)}, parts=True)
    share = F.try_divide((F.col("n_plain") - F.col("n_listed")) * 1.0, F.col("n_tokens"))
    return at.select("doc_id", "n_tokens", F.round(F.coalesce(share, F.lit(0.0)), 4).alias("jargon_density"))


_ANSWER = "CASE event_id % 5 WHEN 0 THEN 'Score: ' || k WHEN 1 THEN 'I would say ' || k || ' of 5.' WHEN 2 THEN 'score: 4.5 or so' WHEN 3 THEN 'no idea' ELSE 'Claims: ' || k || ', ' || (k + 1) END"


def _answers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select("event_id", "k", F.expr(_ANSWER).alias("raw"))


@query(rf"""WITH a AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events), r AS (SELECT event_id, k, {_ANSWER} AS raw FROM a),
s AS (SELECT event_id, raw, TRY_CAST(coalesce(nullif(regexp_extract(raw, '(?i)Score:\s*([1-5](?:\.\d+)?)', 1), ''), nullif(regexp_extract(raw, '\b([1-5](?:\.\d+)?)\b', 1), '')) AS DOUBLE) AS score,
  TRY_CAST(coalesce(nullif(regexp_extract(raw, '(?i)Claims:\s*(-?\d+)', 1), ''), nullif(regexp_extract(raw, '(-?\d+)', 1), '')) AS INT) AS n FROM r)
SELECT event_id, score, CASE WHEN n BETWEEN 0 AND 10 THEN n END AS n_claims FROM s""")
def parse_scores(spark, sf_dir):
    """Scores and bounded integers of judges' answers."""
    raw = F.col("raw")
    return _answers(spark, sf_dir).select("event_id", J.parse_score(raw).alias("score"), J.parse_int_score(raw, "Claims", 0, 10).alias("n_claims"))


_VERDICT = """CASE event_id % 6 WHEN 0 THEN 'Sure: {"value": true, "evidence": "the  Of"} ok' WHEN 1 THEN '{"value": False, "evidence": ""}' WHEN 2 THEN '{"value": "yes"}'
  WHEN 3 THEN '{"value": true, "evi' WHEN 4 THEN 'none' ELSE '{"value": True, "evidence": "a } b"}' END"""


@query("""WITH v AS (SELECT user_id AS paper_id, CASE event_id % 6 WHEN 0 THEN true WHEN 5 THEN true WHEN 1 THEN false END AS value FROM events)
SELECT paper_id, count(*) AS n, count(value) AS n_votes, count_if(value)::BIGINT AS n_true,
  CASE WHEN 2 * count_if(value) <> count(value) THEN 2 * count_if(value) > count(value) END AS verdict FROM v GROUP BY paper_id""")
def judge_verdicts(spark, sf_dir):
    """Verdicts in JSON answers, put to the vote for each paper."""
    at = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), J.parse_verdict(F.expr(_VERDICT)).alias("v"))
    n, yes = F.count("v"), F.count_if(F.col("v.value"))
    return at.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), n.alias("n_votes"), yes.alias("n_true"), J.majority(yes, n).alias("verdict"))


@query(r"""WITH s AS (SELECT doc_id, 'last' AS feature, replace(split_part(text, chr(10), -1), ' ', '  ') AS span FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents
  UNION ALL SELECT doc_id, 'lang', upper(lang) FROM documents UNION ALL SELECT doc_id, 'quality', 'quality ' || quality FROM labels),
c AS (SELECT doc_id, feature, lower(trim(regexp_replace(coalesce(span, ''), '\s+', ' ', 'g'))) AS span FROM s)
SELECT doc_id, feature, span <> '' AND contains(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), span) AS verified FROM c JOIN documents d USING (doc_id)""")
def verify_evidence(spark, sf_dir):
    """Evidence spans of several features, each looked for in its own document: an equi-join on the document, then a search."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    spans = {"last": F.replace(F.element_at(F.split("text", "\n"), -1), F.lit(" "), F.lit("  ")), "source": F.col("source"), "lang": F.upper("lang")}
    one = F.array(*[F.struct(F.lit(k).alias("feature"), c.alias("span")) for k, c in spans.items()])
    s = d.select("doc_id", F.inline(one))
    s = s.unionByName(lab.select("doc_id", F.lit("quality").alias("feature"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("span")))
    at = s.join(d.select("doc_id", "text"), "doc_id")
    return at.select("doc_id", "feature", J.verify_evidence(F.col("text"), F.col("span")).alias("verified"))


def _section_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {text_sql('(?i)' + p)}) THEN '{n}'" for p, n in L.SECTIONS) + " ELSE 'other' END"


_HEADING = "CASE page_id % 8 WHEN 0 THEN '3. Experimental Results' WHEN 1 THEN 'IV Related  Work' WHEN 2 THEN '1 Introduction' WHEN 3 THEN 'Our Method' WHEN 4 THEN 'Broader impact' WHEN 5 THEN '' WHEN 6 THEN 'Appendix A' ELSE h END"


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h FROM pages), q AS (SELECT page_id, {_HEADING} AS heading FROM p),
n AS (SELECT page_id, trim(regexp_replace(heading, '^(?:\d+|[IVX]+)[.\s]+', '')) AS h FROM q) SELECT page_id, {_section_sql('h')} AS section FROM n""")
def section_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("h"))
    return p.select("page_id", T.section_name(F.expr(_HEADING)).alias("section"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<a href="[^"]*"')) AS n_links,
  array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))), ' ') AS links FROM pages""")
def html_fields(spark, sf_dir):
    """Title and sorted distinct links of pages."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    title = F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.size(links).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("links"))


_URL = "CASE page_id % 3 WHEN 0 THEN 'https://arxiv.org/abs/2101.' || (10000 + page_id) || 'v2' WHEN 1 THEN 'arXiv:hep-th/0' || (100000 + page_id) ELSE url END"


@query(rf"""WITH u AS (SELECT page_id, {_URL} AS u FROM pages)
SELECT page_id, nullif(regexp_extract(u, '(?i)(?:arxiv[.:]|abs/|pdf/)(\d{{4}}\.\d{{4,5}}|[a-z\-]+(?:\.[A-Z]{{2}})?/\d{{7}})(v\d+)?', 1), '') AS arxiv_id, split_part(u, '/', -1) AS base FROM u""")
def arxiv_ids(spark, sf_dir):
    u = F.expr(_URL)
    return table(spark, sf_dir, "pages").select("page_id", T.arxiv_id(u).alias("arxiv_id"), F.substring_index(u, "/", -1).alias("base"))
