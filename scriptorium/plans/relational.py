"""Queries over scores, outcomes, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import judge as J
from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.operators import matching as M
from scriptorium.operators import ranks as K
from scriptorium.operators import sampling as P
from scriptorium.operators import stats as S
from scriptorium.plans.base import OUTCOMES, PAPERS, SCORES, outcomes, papers, query, scores, table

@query(f"""WITH s AS ({SCORES}), m AS (SELECT paper_id, prompt, model, median(score) AS med FROM s GROUP BY ALL)
SELECT paper_id, prompt, round(avg(med), 6) AS score, count(DISTINCT model) AS n_models FROM m GROUP BY ALL""")
def judge_medians(spark, sf_dir):
    """Median over runs per judge, then the mean over judges."""
    m = scores(spark, sf_dir).groupBy("paper_id", "prompt", "model").agg(F.median("score").alias("med"))
    return m.groupBy("paper_id", "prompt").agg(F.round(F.avg("med"), 6).alias("score"), F.countDistinct("model").alias("n_models"))


@query(f"""WITH s AS ({SCORES}), m AS (SELECT paper_id, prompt, round(avg(score), 6) AS score FROM s GROUP BY ALL)
SELECT paper_id, max(score) FILTER (WHERE prompt = 0) AS prompt_0, max(score) FILTER (WHERE prompt = 1) AS prompt_1, max(score) FILTER (WHERE prompt = 2) AS prompt_2 FROM m GROUP BY ALL""")
def prompt_matrix(spark, sf_dir):
    """A row for each paper, a column for each prompt."""
    m = scores(spark, sf_dir).groupBy("paper_id").pivot("prompt", [0, 1, 2]).agg(F.round(F.avg("score"), 6))
    return m.select("paper_id", *[F.col(str(k)).alias(f"prompt_{k}") for k in range(3)])


@query(f"""WITH s AS ({SCORES}), m AS (SELECT paper_id, model, median(score) AS med FROM s GROUP BY ALL)
SELECT paper_id, round(avg(med), 6) AS judge_mean, round(stddev_samp(med), 6) AS judge_std, count(med) AS n FROM m GROUP BY ALL""")
def judge_matrix_mean(spark, sf_dir):
    """Median per paper and judge, then mean, deviation and count over judges, in long form."""
    m = scores(spark, sf_dir).groupBy("paper_id", "model").agg(F.median("score").alias("med"))
    return m.groupBy("paper_id").agg(F.round(F.avg("med"), 6).alias("judge_mean"), F.round(F.stddev_samp("med"), 6).alias("judge_std"), F.count("med").alias("n"))


@query(f"""WITH s AS ({SCORES}) SELECT year, model, prompt, round(avg(score) + 1e-9, 4) AS mean, round(stddev_samp(score) + 1e-9, 4) AS std, count(score) AS n
FROM s GROUP BY GROUPING SETS ((year, model), (year, model, prompt))""")
def judge_by_year_model(spark, sf_dir):
    """By year and judge, over all prompts and for each."""
    by = [F.col("year"), F.col("model"), F.col("prompt")]
    sets = scores(spark, sf_dir).groupingSets([by[:2], by], *by)
    value = [F.round(F.avg("score") + 1e-9, 4).alias("mean"), F.round(F.stddev_samp("score") + 1e-9, 4).alias("std"), F.count("score").alias("n")]
    return sets.agg(*value)


@query(f"""WITH s AS ({SCORES}), r AS (SELECT paper_id, prompt, model, count_if(score > 50) AS t, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT paper_id, prompt, CASE WHEN 2 * t <> n THEN 2 * t > n END AS v FROM r)
SELECT paper_id, prompt, count(v) AS n_models, CASE WHEN 2 * count_if(v) <> count(v) THEN 2 * count_if(v) > count(v) END AS verdict FROM m GROUP BY ALL""")
def majority_votes(spark, sf_dir):
    """Votes of runs, then of judges; ties are no vote."""
    yes = F.count_if(F.col("score") > 50)
    r = scores(spark, sf_dir).groupBy("paper_id", "prompt", "model").agg(J.majority(yes, F.count(F.lit(1))).alias("v"))
    return r.groupBy("paper_id", "prompt").agg(F.count("v").alias("n_models"), J.majority(F.count_if("v"), F.count("v")).alias("verdict"))


_SERIES = f"s AS ({SCORES}), y AS (SELECT model, year, avg(score) AS mean FROM s GROUP BY ALL)"
_BASE = "CASE WHEN year <= 10 THEN mean END"
_Z = f"""z AS (SELECT model, year, count({_BASE}) OVER w AS k, (mean - avg({_BASE}) OVER w) / nullif(stddev_samp({_BASE}) OVER w, 0) AS z FROM y WINDOW w AS (PARTITION BY model))"""


def _series(spark, sf_dir):
    y = scores(spark, sf_dir).groupBy("model", "year").agg(F.avg("score").alias("mean"))
    return y.withColumn("z", K.baseline_z("mean", F.col("year") <= 10, "model")).where("z IS NOT NULL")


@query(f"WITH {_SERIES}, {_Z} SELECT model, year, round(z, 6) AS z FROM z WHERE k >= 3")
def baseline_zscore(spark, sf_dir):
    """Yearly means of a judge against its first years."""
    return _series(spark, sf_dir).select("model", "year", F.round("z", 6).alias("z"))


@query(f"WITH {_SERIES}, {_Z} SELECT year, round(avg(z), 6) AS avg_z, round(stddev_samp(z), 6) AS std_z, count(z) AS n FROM z WHERE k >= 3 GROUP BY year")
def model_avg_z(spark, sf_dir):
    return _series(spark, sf_dir).groupBy("year").agg(F.round(F.avg("z"), 6).alias("avg_z"), F.round(F.stddev_samp("z"), 6).alias("std_z"), F.count("z").alias("n"))


@query(f"""WITH o AS ({OUTCOMES}), m AS (SELECT subfield, year, avg(citations) AS mean FROM o GROUP BY ALL),
r AS (SELECT subfield, year, avg(mean) OVER (PARTITION BY subfield ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM m)
SELECT subfield, year, round(v, 4) AS v, true AS smooth FROM r WHERE year IN (1995, 1997) UNION ALL SELECT subfield, year, round(mean, 4), false FROM m WHERE year >= 1999""")
def rolling_mean_series(spark, sf_dir):
    """Smoothed values of early years, raw ones of later years."""
    m = outcomes(spark, sf_dir).groupBy("subfield", "year").agg(F.avg("citations").alias("mean"))
    early = m.withColumn("v", K.rolling_mean("mean", "year", "subfield")).where(F.col("year").isin(1995, 1997))
    early = early.select("subfield", "year", F.round("v", 4).alias("v"), F.lit(True).alias("smooth"))
    return early.unionByName(m.where("year >= 1999").select("subfield", "year", F.round("mean", 4).alias("v"), F.lit(False).alias("smooth")))


_FINAL = f"""o AS (SELECT *, CASE WHEN paper_id % 7 <> 0 THEN citations END AS c, CASE WHEN paper_id % 11 <> 0 THEN subfield END AS f FROM ({OUTCOMES})),
a AS (SELECT paper_id, year, f, c, c / greatest(2026 - year, 1) AS cpy FROM o),
r AS (SELECT *, rank() OVER (PARTITION BY f, year, cpy IS NULL ORDER BY cpy) AS r, count(*) OVER (PARTITION BY f, year, cpy) AS t, count(cpy) OVER (PARTITION BY f, year) AS n FROM a)"""


@query(f"""WITH {_FINAL} SELECT paper_id, year, f AS subfield, round(cpy, 6) AS cites_per_year, round(ln(1 + c), 6) AS log1p_citations,
  CASE WHEN cpy IS NOT NULL THEN round((r + (t - 1) / 2.0) / n, 6) END AS percentile FROM r""")
def outcomes_finalize(spark, sf_dir):
    """Citations by age, and percentile rank within subfield and year; a null subfield is a group."""
    o = outcomes(spark, sf_dir)
    o = o.withColumns({"c": F.when(F.col("paper_id") % 7 != 0, F.col("citations")), "subfield": F.when(F.col("paper_id") % 11 != 0, F.col("subfield"))})
    o = o.withColumn("cpy", F.col("c") / F.greatest(2026 - F.col("year"), F.lit(1)))
    o = K.percentiles(o, "cpy", "pct", "subfield", "year")
    return o.select("paper_id", "year", "subfield", F.round("cpy", 6).alias("cites_per_year"), F.round(F.log1p("c"), 6).alias("log1p_citations"), F.round("pct", 6).alias("percentile"))


_BAND = "CASE " + " ".join(f"WHEN year BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in L.YEAR_BANDS) + " ELSE 'out_of_range' END"
_STRATA = f"""o AS (SELECT paper_id, year, citations, {_BAND} AS year_band FROM ({OUTCOMES})),
w AS (SELECT *, row_number() OVER (PARTITION BY year_band ORDER BY citations, paper_id) AS r, count(*) OVER (PARTITION BY year_band) AS n FROM o),
t AS (SELECT paper_id, year, year_band, CASE WHEN n < 3 THEN 1 WHEN 3 * r < n + 2 THEN 0 WHEN 3 * r < 2 * n + 1 THEN 1 ELSE 2 END AS tercile FROM w)"""


def _strata(spark, sf_dir):
    o = outcomes(spark, sf_dir).withColumn("year_band", K.year_band(F.col("year"), L.YEAR_BANDS))
    return K.terciles(o, "citations", "paper_id", "year_band").select("paper_id", "year", "year_band", "tercile")


@query(f"WITH {_STRATA} SELECT * FROM t")
def year_band_terciles(spark, sf_dir):
    return _strata(spark, sf_dir)


@query(f"""WITH {_STRATA}, s AS (SELECT year_band, tercile, count(*) AS n FROM t GROUP BY ALL), e AS (SELECT *, sum(n) OVER () AS total, n * 1500.0 / sum(n) OVER () AS exact FROM s),
b AS (SELECT *, least(floor(exact), n) AS base FROM e),
k AS (SELECT *, 1500 - sum(base) OVER () AS short, row_number() OVER (ORDER BY (base >= n)::INT, round(exact - base, 9) DESC, year_band, tercile) AS i FROM b)
SELECT year_band, tercile, n, (CASE WHEN total <= 1500 THEN n ELSE base + (i <= short AND base < n)::INT END)::BIGINT AS n_primary FROM k""")
def stratified_allocation(spark, sf_dir):
    """Largest-remainder allocation of 1500 places."""
    s = _strata(spark, sf_dir).groupBy("year_band", "tercile").agg(F.count(F.lit(1)).alias("n"))
    return P.allocate(s, 1500, "year_band", "tercile")


_DRAWN = f"""WITH {_STRATA}, s AS (SELECT year_band, tercile, count(*) AS n FROM t GROUP BY ALL), e AS (SELECT *, sum(n) OVER () AS total, n * 1500.0 / sum(n) OVER () AS exact FROM s),
b AS (SELECT *, least(floor(exact), n) AS base FROM e),
k AS (SELECT *, 1500 - sum(base) OVER () AS short, row_number() OVER (ORDER BY (base >= n)::INT, round(exact - base, 9) DESC, year_band, tercile) AS i FROM b),
a AS (SELECT year_band, tercile, n, CASE WHEN total <= 1500 THEN n ELSE base + (i <= short AND base < n)::INT END AS n_primary FROM k),
d AS (SELECT t.*, row_number() OVER (PARTITION BY year_band, tercile ORDER BY md5(paper_id || '/20261008'), paper_id) - 1 AS stratum_rank FROM t),
j AS (SELECT d.*, stratum_rank >= n_primary AS is_replacement, paper_id % 10 <> 3 AS ok FROM d JOIN a USING (year_band, tercile) WHERE stratum_rank < n_primary + least(n - n_primary, ceil(n_primary * 0.1)))
SELECT paper_id, year, year_band, tercile, stratum_rank, is_replacement, ok,
  is_replacement AND ok AND count_if(is_replacement AND ok) OVER (PARTITION BY year_band, tercile ORDER BY stratum_rank) <= count_if(NOT is_replacement AND NOT ok) OVER (PARTITION BY year_band, tercile) AS promoted FROM j"""


@query(_DRAWN)
def stratified_sample(spark, sf_dir):
    """The draw with replacements, and which of these stand in for rows that failed."""
    drawn = P.stratified_draw(_strata(spark, sf_dir), "paper_id", 1500, 20261008, ["year_band", "tercile"])
    return P.promote(drawn.withColumn("ok", F.col("paper_id") % 10 != 3), "ok", ["year_band", "tercile"])


@query("SELECT doc_id, source FROM documents ORDER BY md5(doc_id || '/20261008'), doc_id LIMIT 100")
def seeded_draw(spark, sf_dir):
    """100 documents by seeded hash: a sampling operator."""
    return P.seeded_draw(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100, 20261008)


@query("""WITH p AS (SELECT p_partkey AS paper_id, 2000 + p_partkey % 3 AS year, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part),
w AS (SELECT p_partkey + 1000000 AS work_id, 2000 + (p_partkey + p_size) % 4 AS wyear, trim(regexp_replace(lower(CASE WHEN p_partkey % 5 = 0 THEN p_name || ' ' || p_brand ELSE p_name END), '[^a-z0-9]+', ' ', 'g')) AS wnorm, p_size AS cites FROM part WHERE p_partkey % 2 = 0),
x AS (SELECT paper_id, work_id, abs(wyear - year) AS gap, -cites AS less FROM p JOIN w ON norm = wnorm AND abs(wyear - year) <= 1 AND norm <> ''),
r AS (SELECT *, row_number() OVER o AS rn, coalesce(lead(gap) OVER o = gap AND lead(less) OVER o = less, false) AS tied FROM x WINDOW o AS (PARTITION BY paper_id ORDER BY gap, less, work_id)),
e AS (SELECT paper_id, CASE WHEN NOT tied THEN work_id END AS work_id, CASE WHEN tied THEN 'ambiguous' ELSE 'exact' END AS match_method FROM r WHERE rn = 1),
a AS (SELECT paper_id, year, list_distinct(string_split(norm, ' ')) AS a FROM p WHERE norm <> '' AND paper_id NOT IN (SELECT paper_id FROM e)), b AS (SELECT work_id, wyear, list_distinct(string_split(wnorm, ' ')) AS b FROM w),
f AS (SELECT paper_id, work_id, len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) AS score FROM a JOIN b ON abs(wyear - year) <= 1),
g AS (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS next FROM f WHERE score >= 0.9 WINDOW o AS (PARTITION BY paper_id ORDER BY score DESC, work_id)),
z AS (SELECT paper_id, CASE WHEN next IS NULL OR score - next >= 0.05 - 1e-12 THEN work_id END AS work_id, CASE WHEN next IS NULL OR score - next >= 0.05 - 1e-12 THEN 'fuzzy' ELSE 'ambiguous' END AS match_method FROM g WHERE rn = 1)
SELECT p.paper_id, m.work_id, coalesce(m.match_method, 'none') AS match_method FROM p LEFT JOIN (FROM e UNION ALL FROM z) m USING (paper_id)""")
def title_match(spark, sf_dir):
    """Parts as papers and works, matched by title within a year."""
    p = table(spark, sf_dir, "part")
    norm = lambda c: T.normalize_title(c, ascii_only=True)
    left = p.select(F.col("p_partkey").alias("paper_id"), (2000 + F.col("p_partkey") % 3).alias("year"), norm(F.col("p_name")).alias("norm"))
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name"))
    right = p.where("p_partkey % 2 = 0").select((F.col("p_partkey") + 1000000).alias("work_id"), (2000 + (F.col("p_partkey") + F.col("p_size")) % 4).alias("wyear"), norm(name).alias("wnorm"), F.col("p_size").alias("cites"))
    return M.pick_match(left, right)


_LONG = "lower(p_name || ' ' || p_type || ' ' || p_brand) || ' n' || p_partkey || ' s' || p_size || ' m' || p_partkey % 97 || ' k' || p_partkey % 89 || ' j' || p_partkey % 83 || ' h' || p_partkey % 79"


@query(rf"""WITH t AS (SELECT *, trim(regexp_replace({_LONG}, '[^a-z0-9]+', ' ', 'g')) AS norm FROM part), p AS (SELECT p_partkey AS paper_id, 2000 + p_partkey % 3 AS year, norm FROM t),
w AS (SELECT p_partkey + 1000000 AS work_id, 2000 + p_partkey % 3 + (p_partkey // 3) % 3 - 1 AS wyear, CASE p_partkey % 6 WHEN 1 THEN norm || ' extra' WHEN 2 THEN 'some other ' || norm || ' title' ELSE norm END AS wnorm, p_size AS cites FROM t WHERE p_partkey % 6 < 5),
v AS (FROM w UNION ALL SELECT work_id + 1000000, wyear, wnorm || CASE WHEN work_id % 2 = 0 THEN ' appendix' ELSE '' END, cites FROM w WHERE work_id % 5 = 0),
x AS (SELECT paper_id, work_id, abs(wyear - year) AS gap, -cites AS less FROM p JOIN v ON norm = wnorm AND abs(wyear - year) <= 1),
r AS (SELECT *, row_number() OVER o AS rn, coalesce(lead(gap) OVER o = gap AND lead(less) OVER o = less, false) AS tied FROM x WINDOW o AS (PARTITION BY paper_id ORDER BY gap, less, work_id)),
e AS (SELECT paper_id, CASE WHEN NOT tied THEN work_id END AS work_id, CASE WHEN tied THEN 'ambiguous' ELSE 'exact' END AS match_method FROM r WHERE rn = 1),
a AS (SELECT paper_id, year, list_distinct(string_split(norm, ' ')) AS a FROM p WHERE paper_id NOT IN (SELECT paper_id FROM e)), b AS (SELECT work_id, wyear, list_distinct(string_split(wnorm, ' ')) AS b FROM v),
f AS (SELECT paper_id, work_id, len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) AS score FROM a JOIN b ON abs(wyear - year) <= 1),
g AS (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS next FROM f WHERE score >= 0.9 WINDOW o AS (PARTITION BY paper_id ORDER BY score DESC, work_id)),
z AS (SELECT paper_id, CASE WHEN next IS NULL OR score - next >= 0.05 - 1e-12 THEN work_id END AS work_id, CASE WHEN next IS NULL OR score - next >= 0.05 - 1e-12 THEN 'fuzzy' ELSE 'ambiguous' END AS match_method FROM g WHERE rn = 1)
SELECT p.paper_id, m.work_id, coalesce(m.match_method, 'none') AS match_method FROM p LEFT JOIN (FROM e UNION ALL FROM z) m USING (paper_id)""")
def fuzzy_title_match(spark, sf_dir):
    """Parts with long names as papers and works: some equal, some with a word more, some with too many, some twice."""
    t = table(spark, sf_dir, "part").withColumn("norm", T.normalize_title(F.expr(_LONG), ascii_only=True))
    left = t.select(F.col("p_partkey").alias("paper_id"), (2000 + F.col("p_partkey") % 3).alias("year"), "norm")
    k = F.col("p_partkey") % 6
    name = F.when(k == 1, F.concat("norm", F.lit(" extra"))).when(k == 2, F.concat(F.lit("some other "), "norm", F.lit(" title"))).otherwise(F.col("norm"))
    year = 2000 + F.col("p_partkey") % 3 + F.floor(F.col("p_partkey") / 3) % 3 - 1
    works = t.where(k < 5).select((F.col("p_partkey") + 1000000).alias("work_id"), year.alias("wyear"), name.alias("wnorm"), F.col("p_size").alias("cites"))
    again = F.concat("wnorm", F.when(F.col("work_id") % 2 == 0, " appendix").otherwise(""))
    twice = works.where("work_id % 5 = 0").select((F.col("work_id") + 1000000).alias("work_id"), "wyear", again.alias("wnorm"), "cites")
    return M.pick_match(left, works.unionByName(twice))


@query("""SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 10""")
def top_categories(spark, sf_dir):
    """The ten most frequent values: a top-k report."""
    return P.top_n(table(spark, sf_dir, "part"), "p_type", 10).select(F.col("p_type").alias("value"), F.col("count").alias("n"))


@query("""WITH t AS (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey LIMIT 10)
SELECT coalesce(t.l_suppkey::VARCHAR, 'other') AS bucket, count(*) AS n FROM lineitem l LEFT JOIN t ON l.l_suppkey = t.l_suppkey GROUP BY ALL""")
def bucket_other(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("supp"), "l_suppkey")
    top = P.top_n(li, "l_suppkey", 10).select("l_suppkey", F.col("l_suppkey").cast("string").alias("bucket"))
    got = li.join(F.broadcast(top), "l_suppkey", "left")  # ten rows
    return got.groupBy(F.coalesce("bucket", F.lit("other")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = d.doc_id AND x.doc_id % 3 = 0)")
def resume_anti_join(spark, sf_dir):
    """Documents that are not done yet."""
    d = table(spark, sf_dir, "documents")
    return M.pending(d, d.where("doc_id % 3 = 0"), ["doc_id"]).select("doc_id", "source")


@query(f"""WITH p AS ({PAPERS}), r AS (SELECT * FROM p WHERE paper_id % 3 = 0 OR year < 2000), a AS (SELECT year, count(*) AS n_papers FROM p GROUP BY year), b AS (SELECT year, count(DISTINCT paper_id) AS n_rows FROM r GROUP BY year)
SELECT year, n_papers, coalesce(n_rows, 0) AS n_rows, coalesce(n_rows, 0) >= n_papers AS complete FROM a LEFT JOIN b USING (year)""")
def resume_year_counts(spark, sf_dir):
    p = papers(spark, sf_dir)
    return M.incomplete_years(p, p.where("paper_id % 3 = 0 OR year < 2000"))


@query(f"""WITH s AS ({SCORES}), p AS (SELECT DISTINCT paper_id FROM s), w AS (SELECT paper_id, unnest(['0', '1', '2', '3']) AS prompt FROM p),
d AS (SELECT paper_id, prompt::VARCHAR AS prompt, count(DISTINCT run) AS n FROM s WHERE model = 'view' GROUP BY ALL)
SELECT paper_id, prompt FROM w LEFT JOIN d USING (paper_id, prompt) WHERE coalesce(n, 0) < 3""")
def resume_runs(spark, sf_dir):
    """Papers and prompts of which not every run is done."""
    s = scores(spark, sf_dir)
    done = s.where("model = 'view'").select("paper_id", F.col("prompt").cast("string").alias("prompt"), "run")
    return M.pending_runs(s.select("paper_id").distinct(), ["0", "1", "2", "3"], 3, done)


@query("""WITH a AS (SELECT year(o_orderdate)::INT AS year, round(avg(o_totalprice), 4) AS order_mean, count(*) AS order_count FROM orders GROUP BY ALL),
b AS (SELECT year(l_shipdate)::INT AS year, round(avg(l_quantity), 4) AS item_mean, count(*) AS item_count FROM lineitem GROUP BY ALL)
SELECT year, order_mean, order_count, item_mean, item_count FROM a FULL JOIN b USING (year)""")
def full_outer_yearly(spark, sf_dir):
    """Yearly aggregates of two sources side by side."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("order_mean"), F.count(F.lit(1)).alias("order_count"))
    b = li.groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.avg("l_quantity"), 4).alias("item_mean"), F.count(F.lit(1)).alias("item_count"))
    return a.join(b, "year", "full_outer")


@query(f"""WITH o AS (SELECT *, {_BAND} AS band FROM ({OUTCOMES})), l AS (SELECT l_orderkey AS paper_id, count(*) AS n FROM lineitem GROUP BY ALL), j AS (SELECT band, citations, n FROM o JOIN l USING (paper_id)),
u AS (SELECT * FROM j UNION ALL SELECT 'all', citations, n FROM j),
r AS (SELECT band, rank() OVER (PARTITION BY band ORDER BY citations) + (count(*) OVER (PARTITION BY band, citations) - 1) / 2.0 AS x, rank() OVER (PARTITION BY band ORDER BY n) + (count(*) OVER (PARTITION BY band, n) - 1) / 2.0 AS y FROM u)
SELECT band, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY band""")
def spearman_by_band(spark, sf_dir):
    """Rank correlation of price and number of items, by band and over all."""
    j = _priced(spark, sf_dir)
    both = j.unionByName(j.withColumn("band", F.lit("all")))
    return S.spearman(both, "citations", "n_items", ["band"], large=True).select("band", "n", F.round("rho", 6).alias("rho"))


def _priced(spark, sf_dir):
    o = outcomes(spark, sf_dir).withColumn("band", K.year_band(F.col("year"), L.YEAR_BANDS))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.count(F.lit(1)).alias("n_items"))
    return o.join(n, "paper_id").select("paper_id", "year", "band", "subfield", "citations", "n_items")


@query()
def spearman_p_values(spark, sf_dir):
    """Correlations by band with their p-values, and whether these are weak."""
    r = S.spearman(_priced(spark, sf_dir), "citations", "n_items", ["band", "subfield"], large=True)
    r = r.withColumn("p", S.spearman_p("rho", "n"))
    return r.withColumn("weak", S.weak_p(F.col("p")))


@query(f"""WITH o AS ({OUTCOMES}) SELECT paper_id, rank() OVER (ORDER BY citations) + (count(*) OVER (PARTITION BY citations) - 1) / 2.0 AS rank FROM o""")
def pooled_ranks(spark, sf_dir):
    """Average ranks over all rows, by range partitions and offsets."""
    return K.pooled_rank(outcomes(spark, sf_dir).select("paper_id", "citations"), "citations").select("paper_id", "rank")


@query(f"""WITH o AS ({OUTCOMES}) SELECT paper_id, year, round((citations - avg(citations) OVER w) / nullif(stddev_samp(citations) OVER w, 0), 6) AS z FROM o WINDOW w AS (PARTITION BY year, subfield)""")
def within_group_z(spark, sf_dir):
    o = outcomes(spark, sf_dir).select("paper_id", "year", "subfield", "citations")
    return K.z_by_group(o, {"z": "citations"}, "year", "subfield").select("paper_id", "year", F.round("z", 6).alias("z"))


@query(f"""WITH s AS ({SCORES}), m AS (SELECT paper_id, prompt, model, median(score) AS med FROM s GROUP BY ALL),
j AS (SELECT a.model AS a, b.model AS b, a.prompt, a.med AS x, b.med AS y FROM m a JOIN m b ON a.paper_id = b.paper_id AND a.prompt = b.prompt AND a.model < b.model),
r AS (SELECT a, b, prompt, rank() OVER (PARTITION BY a, b, prompt ORDER BY x) + (count(*) OVER (PARTITION BY a, b, prompt, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY a, b, prompt ORDER BY y) + (count(*) OVER (PARTITION BY a, b, prompt, y) - 1) / 2.0 AS y FROM j)
SELECT 'judge-judge' AS kind, a, b, prompt, round(corr(x, y), 6) AS value, count(*) AS n FROM r GROUP BY ALL""")
def pairwise_models(spark, sf_dir):
    """Rank correlation of each two judges."""
    m = scores(spark, sf_dir).groupBy("paper_id", "prompt", "model").agg(F.median("score").alias("med"))
    a = m.select("paper_id", "prompt", F.col("model").alias("a"), F.col("med").alias("x"))
    b = m.select("paper_id", "prompt", F.col("model").alias("b"), F.col("med").alias("y"))
    j = a.join(b, ["paper_id", "prompt"]).where("a < b")
    r = S.spearman(j, "x", "y", ["a", "b", "prompt"], n_min=1, large=True)
    return r.select(F.lit("judge-judge").alias("kind"), "a", "b", "prompt", F.round("rho", 6).alias("value"), "n")


@query("""WITH c AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb FROM c)
SELECT n, round(po, 6) AS agreement, round((po - pa * pb - (1 - pa) * (1 - pb)) / nullif(1 - pa * pb - (1 - pa) * (1 - pb), 0), 6) AS kappa FROM t""")
def cohens_kappa(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("quality").alias("x"), (1 - F.col("toxic")).alias("y"))
    return S.cohens_kappa(lab, "x", "y").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(r"""WITH d AS (SELECT d.doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS a, len(regexp_extract_all(split_part(text, chr(10), 1), '[\p{L}\p{N}_]+')) AS b FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id WHERE text <> '')
SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS mean_delta, round(avg((a <> b)::INT), 6) AS share_changed FROM d""")
def paired_deltas(spark, sf_dir):
    """Word counts of labelled texts against those of their first line."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    at = d.join(lab, "doc_id", "left_semi").where("text <> ''")
    at = at.select(T.word_count(F.col("text")).alias("a"), T.word_count(F.split("text", "\n", 2)[0]).alias("b"))
    changed = F.avg((F.col("a") != F.col("b")).cast("int"))
    return at.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("mean_delta"), F.round(changed, 6).alias("share_changed"))


@query("""SELECT doc_id, feature, value FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT (value FOR feature IN (quality, toxic))""")
def unpivot_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "feature", "value")


@query("""SELECT l.doc_id, f.feature, CASE f.feature WHEN 'quality' THEN quality WHEN 'toxic' THEN toxic END AS value FROM labels l CROSS JOIN (VALUES ('quality'), ('toxic'), ('unjudged')) f(feature)""")
def label_sheet(spark, sf_dir):
    """A row for each document and feature, unjudged ones too."""
    lab = table(spark, sf_dir, "labels")
    names = F.explode(F.array(*map(F.lit, ["quality", "toxic", "unjudged"])))
    at = lab.select("*", names.alias("feature"))
    return at.select("doc_id", "feature", F.when(F.col("feature") == "quality", F.col("quality")).when(F.col("feature") == "toxic", F.col("toxic")).alias("value"))


@query("SELECT round_even(value * 2, 0) / 2 AS bin, count(*) AS n FROM events GROUP BY ALL")
def histogram_half_points(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.bround(F.col("value") * 2, 0) / 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH s AS ({SCORES}) SELECT model, count(*) AS n, count_if(score > 50)::BIGINT AS n_high, count(DISTINCT paper_id) AS n_papers FROM s GROUP BY model")
def value_counts(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 50).alias("n_high"), F.countDistinct("paper_id").alias("n_papers"))


_RULES = {
    "id": "coalesce(trim(cast(paper_id AS {S})), '') = ''",
    "venue": "venue NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5')",
    "year": "year < 1987 OR year > 2015",
    "abstract": "n_words < 50",
}


@query(rf"""WITH p AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words FROM ({PAPERS})),
v AS (SELECT paper_id, venue, array_to_string(list_filter([{', '.join(f"CASE WHEN {r.format(S='VARCHAR')} THEN '{k}' END" for k, r in _RULES.items())}], lambda x: x IS NOT NULL), ',') AS violations FROM p)
SELECT venue, count(*) AS n, count_if(violations = '')::BIGINT AS n_ok, count_if(contains(violations, 'abstract'))::BIGINT AS n_short FROM v GROUP BY venue""")
def validate_records(spark, sf_dir):
    """Broken rules of each record, counted by venue."""
    p = papers(spark, sf_dir).withColumn("n_words", F.size(T.tokens(F.col("text"))))
    broken = F.array_compact(F.array(*[F.when(F.expr(r.format(S="STRING")), F.lit(k)) for k, r in _RULES.items()]))
    v = p.select("venue", broken.alias("v"))
    return v.groupBy("venue").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("v") == 0).alias("n_ok"), F.count_if(F.array_contains("v", "abstract")).alias("n_short"))


_LABEL = "CASE doc_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' WHEN 3 THEN quality::{S} ELSE 'TRUE' END"


@query(f"""WITH l AS (SELECT doc_id, lower({_LABEL.format(S='VARCHAR')}) AS raw FROM labels),
b AS (SELECT doc_id, CASE WHEN raw IN ('true', '1', 'yes', 'y') THEN true WHEN raw IN ('false', '0', 'no', 'n') THEN false END AS value FROM l)
SELECT doc_id, value, value IS NULL AS error FROM b""")
def validate_labels(spark, sf_dir):
    """Hand labels as booleans; others are errors."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.expr(_LABEL.format(S="string")).alias("raw"))
    at = lab.select("doc_id", J.parse_boolean(F.col("raw")).alias("value"))
    return at.withColumn("error", F.col("value").isNull())


_CASES = f"""o AS ({OUTCOMES}), l AS (SELECT l_orderkey AS paper_id, count(*) AS n_items FROM lineitem GROUP BY ALL), j AS (SELECT paper_id, year, citations, n_items, CASE WHEN year < 2001 AND paper_id % 50 <> 0 THEN subfield END AS subfield FROM o JOIN l USING (paper_id)),
k AS (SELECT * FROM j WHERE year <= (SELECT max(year) - 1 FROM j) AND subfield IS NOT NULL)"""


@query(f"""WITH {_CASES}, m AS (SELECT avg(ln(1 + citations)) AS a, stddev_samp(ln(1 + citations)) AS b, avg(n_items) AS c, stddev_samp(n_items) AS d FROM k)
SELECT paper_id, year, round((ln(1 + citations) - a) / b, 6) AS y, round((n_items - c) / d, 6) AS n_items, (subfield = 'BUILDING')::INT AS is_building, CASE WHEN n_items > 0 THEN round(ln(n_items), 6) END AS log_items FROM k, m""")
def design_matrix(spark, sf_dir):
    """Standardised design: complete cases, year cap, dummies, logs."""
    at = _design(spark, sf_dir)
    z = S.standardized(at.select("paper_id", "year", "subfield", F.log1p("citations").alias("y"), F.col("n_items").cast("double").alias("x"), "n_items"), ["y", "x"])
    return z.select("paper_id", "year", F.round("y", 6).alias("y"), F.round("x", 6).alias("n_items"), (F.col("subfield") == "BUILDING").cast("int").alias("is_building"), F.when(F.col("n_items") > 0, F.round(F.log("n_items"), 6)).alias("log_items"))


def _design(spark, sf_dir):
    """The year cap comes from all rows, complete or not: those of the last year, and some others, have no subfield here."""
    j = _priced(spark, sf_dir).withColumn("subfield", F.when((F.col("year") < 2001) & (F.col("paper_id") % 50 != 0), F.col("subfield")))
    last = j.agg(F.max("year").alias("last"))
    return j.join(F.broadcast(last), F.col("year") <= F.col("last") - 1).drop("last").dropna(subset=["subfield"])  # one row


@query()
def ols_fe_cluster(spark, sf_dir):
    """Price on items and segment with year effects, errors clustered by year."""
    at = _design(spark, sf_dir).select("year", F.log1p("citations").alias("y"), F.col("n_items").cast("double").alias("n_items"), (F.col("subfield") == "BUILDING").cast("double").alias("building"))
    return spark.createDataFrame(S.ols_fe_cluster(at, "y", ["n_items", "building"], "year"))


_DESIGN = f"""o AS ({OUTCOMES}), l AS (SELECT l_orderkey AS paper_id, count(*) AS n_items FROM lineitem GROUP BY ALL),
j AS (SELECT paper_id, year, citations, n_items, CASE WHEN year < 2001 AND paper_id % 50 <> 0 THEN subfield END AS subfield FROM o JOIN l USING (paper_id)),
k AS (SELECT year, ln(1 + citations) AS y, n_items::DOUBLE AS a, (subfield = 'BUILDING')::INT::DOUBLE AS b FROM j WHERE year <= (SELECT max(year) - 1 FROM j) AND subfield IS NOT NULL)"""


@query(f"""WITH {_DESIGN}, c AS (SELECT year, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM k WINDOW w AS (PARTITION BY year)),
t AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS bee, count(*) AS n, count(DISTINCT year) AS g FROM c),
f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * bee) / (aa * bb - ab * ab) AS ca, (aa * bee - ab * ay) / (aa * bb - ab * ab) AS cb FROM t),
u AS (SELECT year, sum(a * (y - ca * a - cb * b)) AS ua, sum(b * (y - ca * a - cb * b)) AS ub FROM c, f GROUP BY year),
m AS (SELECT sum(ua * ua) AS maa, sum(ua * ub) AS mab, sum(ub * ub) AS mbb FROM u),
v AS (SELECT *, g * 1.0 / (g - 1) * (n - 1) / (n - 2 - g) AS scale FROM f, m)
SELECT 'n_items' AS term, round(ca, 8) AS coef, round(sqrt(scale * (bb * bb * maa - 2 * bb * ab * mab + ab * ab * mbb)) / det, 8) AS se, n AS n_obs, g AS n_groups FROM v
UNION ALL SELECT 'building', round(cb, 8), round(sqrt(scale * (ab * ab * maa - 2 * aa * ab * mab + aa * aa * mbb)) / det, 8), n, g FROM v""")
def ols_fe_coefficients(spark, sf_dir):
    """Coefficients and clustered errors of ols_fe_cluster, rounded, without p-values."""
    got = ols_fe_cluster(spark, sf_dir)
    return got.select("term", F.round("coef", 8).alias("coef"), F.round("se", 8).alias("se"), "n_obs", "n_groups")


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY ALL), j AS (SELECT o_custkey FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT count(*) AS n_obs, count(DISTINCT o_custkey) AS n_groups, true AS slope_found, true AS intercepts_differ FROM j""")
def mixed_lm_customers(spark, sf_dir):
    """A random intercept for each customer: price on items, with an effect of 0.5 an item and one of each customer (variance
    0.16, from the key's remainder) put into the price. Groups go with the data; their number has no bound."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
    j = table(spark, sf_dir, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"))
    effect = (F.col("o_custkey") % 5 - 2) * (0.4 / 2**0.5)
    noise = (F.pmod(F.xxhash64("o_orderkey"), F.lit(1000)) / 1000.0 - 0.5) * 2
    at = j.select("o_custkey", (0.5 * F.col("n_items") + effect + noise).alias("y"), F.col("n_items").cast("double").alias("n_items"))
    got = spark.createDataFrame(S.mixed_lm(at, "y", ["n_items"], "o_custkey")).where("term = 'n_items'")
    return got.select("n_obs", "n_groups", F.col("coef").between(0.48, 0.52).alias("slope_found"), F.col("group_var").between(0.12, 0.2).alias("intercepts_differ"))


@query()
def mixed_lm(spark, sf_dir):
    """The same with a random intercept for each year."""
    at = _design(spark, sf_dir).select("year", F.log1p("citations").alias("y"), F.col("n_items").cast("double").alias("n_items"))
    return spark.createDataFrame(S.mixed_lm(at, "y", ["n_items"], "year"))


@query("""WITH a AS (SELECT o_orderkey, o_totalprice FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS missing, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS extra""")
def verify_tables(spark, sf_dir):
    """Whether two tables hold the same rows."""
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.same_rows(a, a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))


@query(f"""WITH s AS ({SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, model ORDER BY (score > 50) DESC, year, score, prompt, run) AS rn FROM s)
SELECT paper_id, model, year, round(score, 6) AS score FROM r WHERE rn = 1""")
def first_verified(spark, sf_dir):
    """The first verified span of each paper and judge, else the first."""
    order = [F.desc(F.col("score") > 50), "year", "score", "prompt", "run"]
    got = S.first_by(scores(spark, sf_dir), ["paper_id", "model"], order, ["year", "score"])
    return got.withColumn("score", F.round("score", 6))


@query(f"""WITH p AS ({PAPERS}), a AS (SELECT paper_id, year, length(text) AS n_chars FROM p), j AS (SELECT a.*, l.quality, l.toxic FROM a LEFT JOIN labels l ON a.paper_id = l.doc_id)
SELECT year, count(*) AS n, count(quality) AS n_labelled, round(avg(n_chars) FILTER (WHERE quality = 1), 4) AS good_chars, coalesce(sum(toxic), 0)::BIGINT AS n_toxic FROM j GROUP BY year""")
def labelled_metrics(spark, sf_dir):
    """A metric of every paper with labels of some, by year."""
    p = papers(spark, sf_dir).select("paper_id", "year", F.length("text").alias("n_chars"))
    j = p.join(table(spark, sf_dir, "labels"), F.col("paper_id") == F.col("doc_id"), "left")
    good = F.avg(F.when(F.col("quality") == 1, F.col("n_chars")))
    return j.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.round(good, 4).alias("good_chars"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"))


@query("""WITH c AS (SELECT label, (embedding[1] > 0)::INT * 2 + (embedding[2] > 0)::INT AS cluster, count(*) AS n FROM embeddings GROUP BY ALL),
a AS (SELECT sum(n * (n - 1) / 2.0) AS x FROM c), r AS (SELECT sum(s * (s - 1) / 2.0) AS x FROM (SELECT sum(n) AS s FROM c GROUP BY label)), k AS (SELECT sum(s * (s - 1) / 2.0) AS x FROM (SELECT sum(n) AS s FROM c GROUP BY cluster)), t AS (SELECT sum(n) AS n FROM c)
SELECT round((a.x - r.x * k.x / (n * (n - 1) / 2.0)) / ((r.x + k.x) / 2 - r.x * k.x / (n * (n - 1) / 2.0)), 6) AS ari FROM a, r, k, t""")
def ari_contingency(spark, sf_dir):
    """Adjusted Rand index of labels against signs of two dimensions."""
    from scriptorium.operators.topics import adjusted_rand

    at = table(spark, sf_dir, "embeddings").select("label", ((F.col("embedding")[0] > 0).cast("int") * 2 + (F.col("embedding")[1] > 0).cast("int")).alias("cluster"))
    return adjusted_rand(at, "label", "cluster").select(F.round("ari", 6).alias("ari"))


def _topics(spark, sf_dir):
    from scriptorium.operators.topics import topics

    return topics(papers(spark, sf_dir).select("paper_id", "text"), 15, 20261008)


@query()
def topics_kmeans(spark, sf_dir):
    """A topic for each document."""
    return _topics(spark, sf_dir)[0]


@query()
def topic_terms(spark, sf_dir):
    """The eight terms of most weight of each topic."""
    return _topics(spark, sf_dir)[1]


@query("SELECT lang, count(*) AS n, true AS apart FROM documents GROUP BY lang")
def topic_languages(spark, sf_dir):
    """Whether three quarters or more of a language's documents lie in topics where it is the most frequent: the texts share
    no words between languages, so topics must tell them apart."""
    at = _topics(spark, sf_dir)[0].join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "lang"), "paper_id")
    cells = at.groupBy("topic", "lang").agg(F.count(F.lit(1)).alias("n"))
    main = cells.groupBy("topic").agg(F.max_by("lang", F.struct("n", "lang")).alias("main"))
    got = cells.join(main, "topic").groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("lang") == F.col("main"), F.col("n")).otherwise(0)).alias("own"))
    return got.select("lang", "n", (F.col("own") >= 0.75 * F.col("n")).alias("apart"))


@query("SELECT count(*) FILTER (('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::INT % 3 = 2) AS held_out_n, true AS stable, true AS informed FROM documents")
def topic_stability(spark, sf_dir):
    """Whether models of two thirds of the documents agree on the last: adjusted Rand index and mutual information over 0.5.
    With four topics, as there are four languages, the two models must find the same ones."""
    from scriptorium.operators.topics import embedded, stability

    low = embedded(papers(spark, sf_dir).select("paper_id", "text"))[0]
    return stability(low, 4, 20261008).select("held_out_n", (F.col("ari") > 0.5).alias("stable"), (F.col("ami") > 0.5).alias("informed"))


@query("""SELECT user_id, count(*) AS n_events, max(value) AS most, arg_max(event_type, (value, -event_id)) AS best_type FROM events GROUP BY user_id""")
def argmax_concept(spark, sf_dir):
    """The entry of highest score of each owner, the earlier of equal ones."""
    best = F.max_by("event_type", F.struct("value", -F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("value").alias("most"), best.alias("best_type"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    """The stream's windowed counts, run over the whole table at once."""
    from scriptorium.streaming.incremental import windowed_counts

    got = windowed_counts(table(spark, sf_dir, "events"))
    return got.withColumn("mean", F.round("mean", 6))


@query()
def line_sections(spark, sf_dir):
    """Sections of documents as lines; headings are put before some lines."""
    from scriptorium.sources.fulltext import documents, line_sections

    p = papers(spark, sf_dir).select("paper_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    heading = F.element_at(F.array(*map(F.lit, ["1 Introduction", "2 Method", "Results", "5. Conclusion"])), (F.col("line_no") / 2 % 4 + 1).cast("int"))
    extra = p.where("line_no % 2 = 0").select("paper_id", (F.col("line_no") - 0.5).alias("line_no"), heading.alias("text"), F.lit(14.0).alias("size"))
    lines = p.select("paper_id", F.col("line_no").cast("double").alias("line_no"), "text", F.lit(10.0).alias("size")).unionByName(extra)
    return documents(line_sections(lines.where("text <> ''"), "paper_id"), "paper_id", "fallback")


@query()
def tei_sections(spark, sf_dir):
    """Documents wrapped as TEI, parsed and named; every tenth is cut short and fails."""
    from scriptorium.sources.fulltext import documents, read_tei

    text = F.regexp_replace("text", "[<>&\\x00-\\x08]", " ")
    head, tail = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>2 Our Method</head><p>', "</p></div></body></text></TEI>"
    xml = F.concat(F.lit(head), text, F.when(F.col("paper_id") % 10 == 0, "").otherwise(tail))
    p = papers(spark, sf_dir).select("paper_id", xml.alias("xml"))
    return documents(read_tei(p, "paper_id", "xml"), "paper_id", "grobid")


@query("""SELECT doc_id, concat_ws(chr(10) || chr(10), '[Method]' || chr(10) || split_part(text, chr(10), 1), '[results]' || chr(10) || source) AS prompt_text, 'Q: baseline? T: ' || source AS prompt FROM documents""")
def feature_prompts(spark, sf_dir):
    """What a judge reads of a document for one feature."""
    d = table(spark, sf_dir, "documents")
    one = lambda h, n, t: F.struct(F.lit(h).alias("heading"), F.lit(n).alias("normalized"), t.alias("text"))
    line = F.split("text", "\n", 2)[0]
    sections = F.array(one("Method", "methods", line), one("Intro", "introduction", F.lit("no")), one("", "results", F.col("source")))
    none = F.array().cast("array<string>")
    text = J.feature_text(sections, none, none, "baseline_present", 10**6)
    return d.select("doc_id", text.alias("prompt_text"), J.build_prompt("Q: {QUESTION} T: {TEXT}", "baseline?", F.col("source")).alias("prompt"))
