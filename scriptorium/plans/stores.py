"""Queries over tables that are written and read again: stable files, topped-up streams, label sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import labels as H
from scriptorium.operators import stats as S
from scriptorium.plans.base import PAPERS, SCORES, papers, query, scores, table
from scriptorium.plans.relational import _CASES, _design
from scriptorium.sources import html, stable
from scriptorium.sources.scratch import new_path
from scriptorium.streaming import incremental


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_quantity) - 1 AS i FROM lineitem)
SELECT (i // 5000)::BIGINT AS file, count(*) AS n_rows, min(l_returnflag) AS first_flag, max(l_returnflag) AS last_flag, round(sum(l_quantity), 2)::DOUBLE AS quantity, true AS same FROM r GROUP BY ALL""")
def stable_files(spark, sf_dir):
    """Order lines with many equal rows, written twice from other partitions in files of 5000 rows: what each file holds, and
    whether its bytes are the same."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    a, b = new_path(spark, "stable"), new_path(spark, "stable")
    stable.write_stable(rows, ["l_returnflag"], a, 5000)
    stable.write_stable(rows.repartition(5, "l_quantity"), ["l_returnflag"], b, 5000)
    why = stable.changed_files(stable.digests(spark, a), stable.digests(spark, b))
    held = spark.read.parquet(a).groupBy(F.col("file").cast("long").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("l_returnflag").alias("first_flag"),
        F.max("l_returnflag").alias("last_flag"),
        F.round(F.sum("l_quantity"), 2).cast("double").alias("quantity"),
    )
    return held.join(why, "file", "left").withColumn("same", F.col("why").isNull()).drop("why")


@query(f"""WITH p AS (SELECT *, paper_id % 10 <> 9 OR year < 2000 AS here FROM ({PAPERS}))
SELECT year, count(*) AS n_papers, count(*) FILTER (WHERE here) AS n_rows, count(*) FILTER (WHERE here) = count(*) AS complete, coalesce(sum(length(text)) FILTER (WHERE here), 0)::BIGINT AS n_chars FROM p GROUP BY year""")
def stream_top_up(spark, sf_dir):
    """Papers that arrive in two runs of a stream, the second with those of the first again: each is computed once, and years
    are complete or not; some papers never come."""
    p = papers(spark, sf_dir).select("paper_id", "year", "text")
    source, path, mark = (new_path(spark, x) for x in ("arrivals", "topped-up", "stream-state"))
    here = p.where("paper_id % 10 <> 9 OR year < 2000")

    def chars(rows):
        return rows.select("paper_id", "year", F.length("text").cast("long").alias("n"))

    for rows in (here.where("paper_id % 3 <> 0"), here):
        rows.write.mode("append").parquet(source)
        incremental.top_up(spark, source, "paper_id long, year int, text string", chars, path, mark).awaitTermination()
    n = spark.read.parquet(f"{path}/rows").groupBy("year").agg(F.sum("n").alias("n_chars"))
    return incremental.progress(spark, path, p).join(n, "year", "left").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))


_CLARITY = "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN '9' WHEN 4 THEN ' 3.7' WHEN 5 THEN '-1' WHEN 6 THEN CAST(1 + doc_id % 5 AS {S}) END"


@query(f"""WITH s AS (SELECT doc_id AS paper_id, {_CLARITY.format(S='VARCHAR')} AS clarity, quality::VARCHAR AS quality FROM labels),
u AS (SELECT paper_id, 'clarity' AS prompt, clarity AS raw, 1 AS a, 5 AS b FROM s UNION ALL SELECT paper_id, 'quality', quality, 0, 1 FROM s),
v AS (SELECT *, trunc(TRY_CAST(trim(raw) AS DOUBLE))::BIGINT AS v FROM u),
e AS (SELECT *, CASE WHEN trim(coalesce(raw, '')) = '' THEN 'empty' WHEN v IS NULL THEN 'not an integer' WHEN v NOT BETWEEN a AND b THEN 'outside [' || a || ',' || b || ']' END AS error FROM v)
SELECT paper_id::VARCHAR AS paper_id, prompt, CASE WHEN error IS NULL THEN v END AS value, error FROM e""")
def label_sheet(spark, sf_dir):
    """A label sheet in long form: integers within their prompts' bounds, and the errors of the others."""
    lab = table(spark, sf_dir, "labels")
    sheet = lab.select(F.col("doc_id").alias("paper_id"), F.expr(_CLARITY.format(S="STRING")).alias("clarity"), F.col("quality").cast("string").alias("quality"))
    return H.bounded_labels(sheet, {"clarity": (1, 5), "quality": (0, 1)})


@query(f"""WITH {_CASES}, t AS (SELECT l_orderkey AS paper_id, bool_or(l_returnflag = 'R')::INT AS has_return, bool_or(l_linestatus = 'O')::INT AS has_open FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL),
f AS (SELECT * FROM k JOIN t USING (paper_id)), m AS (SELECT avg(ln(1 + citations)) AS a, stddev_samp(ln(1 + citations)) AS b, avg(n_items) AS c, stddev_samp(n_items) AS d FROM f)
SELECT paper_id, year, round((ln(1 + citations) - a) / b, 6) AS y, round((n_items - c) / d, 6) AS n_items, has_return, has_open FROM f, m""")
def design_fulltext(spark, sf_dir):
    """The design of papers whose full text was judged: an inner join, then standardised anew; predictors of one value go."""
    li = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("paper_id"))
    flags = {"has_return": F.col("l_returnflag") == "R", "has_open": F.col("l_linestatus") == "O", "never": F.col("l_quantity") < 0}
    judged = li.agg(*[F.bool_or(c).cast("int").alias(k) for k, c in flags.items()])
    at = _design(spark, sf_dir).join(judged, "paper_id")
    kept = S.varied(at, list(flags))
    z = at.select("paper_id", "year", F.log1p("citations").alias("y"), F.col("n_items").cast("double").alias("n_items"), *kept)
    z = S.standardized(z, ["y", "n_items"])
    return z.select("paper_id", "year", F.round("y", 6).alias("y"), F.round("n_items", 6).alias("n_items"), *kept)


_MODELS = ("click", "error", "purchase", "signup", "view")
_WIDE = ", ".join(f"round(avg(score) FILTER (WHERE model = '{m}') + 1e-9, 4) AS {m}_mean, round(stddev_samp(score) FILTER (WHERE model = '{m}') + 1e-9, 4) AS {m}_std, count(score) FILTER (WHERE model = '{m}') AS {m}_count" for m in _MODELS)


@query(f"WITH s AS (SELECT * FROM ({SCORES}) WHERE model <> 'view' OR year > 5) SELECT year, {_WIDE} FROM s GROUP BY year")
def judge_scores_wide(spark, sf_dir):
    """Mean, deviation and count of each judge's scores by year, a column for each; one judge has scored no early year."""
    s = scores(spark, sf_dir).where("model <> 'view' OR year > 5")
    return S.wide_summary(s, "year", "model", "score")


_N = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}_]+'))"


@query(f"""WITH c AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS i, max(turn) FILTER (WHERE role = 'assistant') AS j FROM conversations WHERE text <> '' GROUP BY conv_id),
p AS (SELECT {_N.format('a.text')} AS a, {_N.format('b.text')} AS b FROM c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = i JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = j WHERE a.role = 'user' AND b.role = 'assistant' AND a.text <> '' AND b.text <> '')
SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS mean_delta, round(avg((a <> b)::INT), 6) AS share_changed FROM p""")
def paired_texts(spark, sf_dir):
    """Words of two versions of a text, the first question and the last answer of a conversation, where neither is empty."""
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    c = c.select("conv_id", "turn", "role", T.word_count(F.col("text")).alias("n"))
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("n", "turn").alias("a"))
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("n", "turn").alias("b"))
    at = first.join(last, "conv_id")
    means = {"mean_a": F.avg("a"), "mean_b": F.avg("b"), "mean_delta": F.avg(F.col("a") - F.col("b")), "share_changed": F.avg((F.col("a") != F.col("b")).cast("int"))}
    return at.agg(F.count(F.lit(1)).alias("n"), *[F.round(v, 6).alias(k) for k, v in means.items()])


_LINKED = """html || CASE page_id % 4 WHEN 0 THEN '<a class="x" href="/paper_files/paper/2021/hash/ab' || page_id || '-Abstract-Conference.html">A</a><A title="href=no" href="/paper/2020/hash/0f-Abstract.html">B</A>'
  WHEN 1 THEN '<a href="/paper/2021/hash/cd-Abstract.html?a=1&amp;b=2021"><a href="/2021/hash/zz-Abstract.html"><a href="/2021/Paper">' ELSE '' END"""


@query(rf"""WITH p AS (SELECT page_id, {_LINKED} AS html FROM pages),
l AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^">]*)"', 1), lambda x: replace(x, '&amp;', '&')), lambda x: contains(x, 'Abstract') AND contains(x, '2021')) AS links FROM p)
SELECT page_id, array_to_string(links, ' ') AS links, array_to_string(list_filter(list_transform(links, lambda x: regexp_extract(x, '/hash/([a-f0-9]+)-Abstract', 1)), lambda x: x <> ''), ' ') AS keys FROM l""")
def abstract_links(spark, sf_dir):
    """Links to a year's abstracts on each page, and their keys; some pages get such links."""
    links = html.abstract_links(F.expr(_LINKED), F.lit(2021))
    at = table(spark, sf_dir, "pages").select("page_id", links.alias("l"))
    keys = F.array_compact(F.transform("l", lambda x: html.link_key(x)))
    return at.select("page_id", F.array_join("l", " ").alias("links"), F.array_join(keys, " ").alias("keys"))
