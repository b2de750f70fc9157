"""Queries that join several results: validity, correlations, reports, patches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import judge as J
from scriptorium.functions import text as T
from scriptorium.functions.validation import VENUES, YEARS, violations
from scriptorium.operators import matching as M
from scriptorium.operators import ranks as K
from scriptorium.operators import stats as S
from scriptorium.plans import texts
from scriptorium.plans.base import ORACLES, OUTCOMES, PAPERS, SCORES, outcomes, papers, query, scores, table

READABILITY = """word_count avg_sentence_length avg_syllables_per_word flesch_ease flesch_kincaid gunning_fog smog dale_chall spache
coleman_liau ari linsear_write lix rix forcast powers_sumner_kearl""".split()
_YEARLY = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, count({c}) AS {c}_count" for c in READABILITY)


@query(f"SELECT (1987 + doc_id % 39)::INT AS year, {_YEARLY} FROM ({ORACLES['readability_rows']}) GROUP BY 1")
def readability_yearly(spark, sf_dir):
    """Mean, deviation and count of sixteen readability scores by year."""
    at = texts.readability_rows(spark, sf_dir).withColumn("year", (1987 + F.col("doc_id") % 39).cast("int"))
    aggs = []
    for c in READABILITY:
        aggs += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 6).alias(f"{c}_std"), F.count(c).alias(f"{c}_count")]
    return at.groupBy("year").agg(*aggs)


_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"


@query(f"""WITH a AS (SELECT paper_id, coalesce(b.text, p.text) AS abstract, b.text IS NOT NULL AS patched FROM ({PAPERS}) p
  LEFT JOIN (SELECT * FROM benchmark WHERE {_WORDS.format('text')} >= 5) b ON paper_id = item_id),
f AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE {_WORDS.format('text')} >= 30)
SELECT paper_id, CASE WHEN {_WORDS.format('abstract')} < 30 AND f.text IS NOT NULL THEN f.text ELSE abstract END AS abstract,
  patched OR ({_WORDS.format('abstract')} < 30 AND f.text IS NOT NULL) AS patched FROM a LEFT JOIN f ON paper_id = conv_id AND rn = 1""")
def patched_abstracts(spark, sf_dir):
    """Texts replaced from a cache by key; those still short from fallback sources, the first that is long enough."""
    p = papers(spark, sf_dir).select("paper_id", F.col("text").alias("abstract"))
    cache = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("paper_id"), F.col("text").alias("new"))
    more = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), "turn", F.col("text").alias("new"))
    return M.patched(p, cache, more, "paper_id", "abstract", "turn")


_RECORD = """doc_id AS paper_id, CASE doc_id % 11 WHEN 0 THEN 'acl' WHEN 1 THEN 'icml' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'arxiv' ELSE 'neurips' END AS venue,
  (1987 + doc_id % 47) AS year, source AS title, text AS abstract, CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'A B, ,C' ELSE 'A B,C D' END AS names,
  CASE WHEN doc_id % 11 IN (2, 5) THEN 'cs.CL' END AS category"""


@query(rf"""WITH r AS (SELECT {_RECORD} FROM documents), v AS (SELECT paper_id, venue, list_filter([
  CASE WHEN venue NOT IN {VENUES} THEN 'venue' END, CASE WHEN year NOT BETWEEN {YEARS[0]} AND {YEARS[1]} THEN 'year' END,
  CASE WHEN {_WORDS.format('title')} < 1 THEN 'title' END, CASE WHEN {_WORDS.format('abstract')} < 5 THEN 'abstract' END,
  CASE WHEN len(list_filter(string_split(names, ','), lambda x: trim(x) = '')) > 0 THEN 'authors' END,
  CASE WHEN (venue = 'arxiv') <> (category IS NOT NULL) THEN 'arxiv' END], lambda x: x IS NOT NULL) AS broken FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY venue, len(broken) > 0 ORDER BY paper_id) AS rn FROM v)
SELECT venue, count(*) AS n, count_if(len(broken) = 0)::BIGINT AS n_ok,
  coalesce(string_agg(paper_id || ' ' || array_to_string(broken, ','), '; ' ORDER BY paper_id) FILTER (WHERE len(broken) > 0 AND rn <= 5), '') AS failures FROM n GROUP BY venue""")
def validation_report(spark, sf_dir):
    """All rules on every record; by venue the records in order and the first five failures, with their rules."""
    r = table(spark, sf_dir, "documents").selectExpr(*_expressions(_RECORD))
    authors, categories = F.split("names", ","), F.when(F.col("category").isNotNull(), F.array("category"))
    got = violations(F.col("paper_id").cast("string"), F.col("venue"), F.col("year"), F.col("title"), F.col("abstract"), authors, categories, F.col("category"))
    v = r.select("paper_id", "venue", got.alias("broken"))
    fails = F.size("broken") > 0
    first = F.row_number().over(Window.partitionBy("venue").orderBy("paper_id"))
    five = v.where(fails).withColumn("rn", first).where("rn <= 5").groupBy("venue")
    said = F.sort_array(F.collect_list(F.struct("paper_id", F.array_join("broken", ",").alias("rules"))))
    five = five.agg(F.array_join(F.transform(said, lambda x: F.concat_ws(" ", x.paper_id.cast("string"), x.rules)), "; ").alias("failures"))
    n = v.groupBy("venue").agg(F.count(F.lit(1)).alias("n"), F.count_if(~fails).alias("n_ok"))
    return n.join(five, "venue", "left").withColumn("failures", F.coalesce("failures", F.lit("")))


def _expressions(sql: str) -> list[str]:
    """The select list, cut at commas outside brackets and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(sql):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(sql[start:i])
            start = i + 1
    return [*out, sql[start:]]


_JUDGED = f"""s AS ({SCORES}), m AS (SELECT paper_id, model, median(score) AS med FROM s GROUP BY ALL), j AS (SELECT paper_id, avg(med) AS judge FROM m GROUP BY paper_id),
d AS (SELECT paper_id, year, length(text) * 1.0 AS n_chars, len(regexp_extract_all(text, '\\n')) * 1.0 AS n_lines, len(regexp_extract_all(text, ' ')) * 1.0 AS n_spaces FROM ({PAPERS})),
w AS (SELECT paper_id, year, judge, metric, value FROM (FROM d JOIN j USING (paper_id)) UNPIVOT (value FOR metric IN (n_chars, n_lines, n_spaces)))"""


def _rank_sql(value: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0"


@query(f"""WITH {_JUDGED}, z AS (SELECT *, round((value - avg(value) OVER y) / nullif(stddev_samp(value) OVER y, 0), 9) AS zv, round((judge - avg(judge) OVER y) / nullif(stddev_samp(judge) OVER y, 0), 9) AS zj FROM w WINDOW y AS (PARTITION BY metric, year)),
p AS (SELECT metric, {_rank_sql('value', 'metric')} AS x, {_rank_sql('judge', 'metric')} AS y FROM w),
q AS (SELECT metric, {_rank_sql('zv', 'metric')} AS x, {_rank_sql('zj', 'metric')} AS y FROM z WHERE zv IS NOT NULL AND zj IS NOT NULL)
SELECT metric, n, r_pooled, r_within FROM (SELECT metric, count(*) AS n, round(corr(x, y), 6) AS r_pooled FROM p GROUP BY metric) JOIN (SELECT metric, round(corr(x, y), 6) AS r_within FROM q GROUP BY metric) USING (metric) ORDER BY r_pooled""")
def metric_correlations(spark, sf_dir):
    """Rank correlation of the judges' mean with each of many metrics, over all papers and within years, lowest first."""
    m = scores(spark, sf_dir).groupBy("paper_id", "model").agg(F.median("score").alias("med"))
    judge = m.groupBy("paper_id").agg(F.avg("med").alias("judge"))
    wide = papers(spark, sf_dir).select(
        "paper_id",
        "year",
        F.length("text").cast("double").alias("n_chars"),
        F.regexp_count("text", F.lit("\n")).cast("double").alias("n_lines"),
        F.regexp_count("text", F.lit(" ")).cast("double").alias("n_spaces"),
    )
    at = wide.join(judge, "paper_id").unpivot(["paper_id", "year", "judge"], ["n_chars", "n_lines", "n_spaces"], "metric", "value")
    at = K.z_by_group(at, {"zv": "value", "zj": "judge"}, "metric", "year").withColumns({"zv": F.round("zv", 9), "zj": F.round("zj", 9)})
    pooled = S.spearman(at, "value", "judge", ["metric"], large=True).withColumn("r_pooled", F.round("rho", 6)).drop("rho")
    within = S.spearman(at, "zv", "zj", ["metric"], large=True).select("metric", F.round("rho", 6).alias("r_within"))
    return pooled.join(within, "metric").orderBy("r_pooled")


_MODEL = f"s AS ({SCORES}), m AS (SELECT paper_id, model, median(score) AS med, CASE WHEN 2 * count_if(score > 50) <> count(*) THEN 2 * count_if(score > 50) > count(*) END AS vote FROM s GROUP BY ALL)"


@query(f"""WITH {_MODEL}, jj AS (SELECT a.model AS a, b.model AS b, a.med AS x, b.med AS y FROM m a JOIN m b ON a.paper_id = b.paper_id AND a.model < b.model),
jt AS (SELECT model AS a, 'n_chars' AS b, med AS x, length(text) AS y FROM m JOIN documents ON paper_id = doc_id),
u AS (SELECT 'judge-judge' AS kind, * FROM jj UNION ALL SELECT 'judge-tier1', * FROM jt),
r AS (SELECT kind, a, b, {_rank_sql('x', 'kind, a, b')} AS x, {_rank_sql('y', 'kind, a, b')} AS y FROM u),
h AS (SELECT model, vote::INT AS v, quality AS q FROM m JOIN labels ON paper_id = doc_id WHERE vote IS NOT NULL AND quality IS NOT NULL),
k AS (SELECT model, count(*) AS n, avg((v = q)::INT) AS po, avg(v) AS pv, avg(q) AS pq FROM h GROUP BY model)
SELECT kind, a, b, 'spearman' AS stat, round(corr(x, y), 6) AS value, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT 'judge-human', model, 'quality', 'kappa', round((po - pv * pq - (1 - pv) * (1 - pq)) / nullif(1 - pv * pq - (1 - pv) * (1 - pq), 0), 6), n FROM k""")
def validity_table(spark, sf_dir):
    """Judges against each other, against hand labels and against a plain metric, in one long table."""
    s = scores(spark, sf_dir)
    vote = J.majority(F.count_if(F.col("score") > 50), F.count(F.lit(1))).alias("vote")
    m = s.groupBy("paper_id", "model").agg(F.median("score").alias("med"), vote)
    one = m.select("paper_id", F.col("model").alias("a"), F.col("med").alias("x"))
    two = m.select("paper_id", F.col("model").alias("b"), F.col("med").alias("y"))
    jj = one.join(two, "paper_id").where("a < b").select(F.lit("judge-judge").alias("kind"), "a", "b", "x", "y")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.length("text").cast("double").alias("y"))
    jt = one.join(d, "paper_id").select(F.lit("judge-tier1").alias("kind"), "a", F.lit("n_chars").alias("b"), "x", "y")
    ranked = S.spearman(jj.unionByName(jt), "x", "y", ["kind", "a", "b"], n_min=2, large=True)
    ranked = ranked.select("kind", "a", "b", F.lit("spearman").alias("stat"), F.round("rho", 6).alias("value"), "n")
    h = m.join(table(spark, sf_dir, "labels"), F.col("paper_id") == F.col("doc_id")).where("vote IS NOT NULL AND quality IS NOT NULL")
    h = h.select("model", F.col("vote").cast("int").alias("v"), F.col("quality").alias("q"))
    k = h.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("v") == F.col("q")).cast("int")).alias("po"), F.avg("v").alias("pv"), F.avg("q").alias("pq"))
    chance = F.col("pv") * F.col("pq") + (1 - F.col("pv")) * (1 - F.col("pq"))
    kappa = F.round(F.try_divide(F.col("po") - chance, 1 - chance), 6)
    return ranked.unionByName(k.select(F.lit("judge-human").alias("kind"), F.col("model").alias("a"), F.lit("quality").alias("b"), F.lit("kappa").alias("stat"), kappa.alias("value"), "n"))


@query(f"""WITH s AS ({SCORES}) SELECT paper_id, model, median(score) FILTER (WHERE prompt = 0) AS prompt_0, median(score) FILTER (WHERE prompt = 1) AS prompt_1, median(score) FILTER (WHERE prompt = 2) AS prompt_2 FROM s GROUP BY ALL""")
def model_prompt_medians(spark, sf_dir):
    """Median over runs of each paper and judge, a column for each prompt."""
    m = scores(spark, sf_dir).groupBy("paper_id", "model").pivot("prompt", [0, 1, 2]).agg(F.median("score"))
    return m.select("paper_id", "model", *[F.col(str(k)).alias(f"prompt_{k}") for k in range(3)])


_VOTE = "CASE WHEN 2 * count_if(score > 50) FILTER (WHERE prompt = {0}) <> count(*) FILTER (WHERE prompt = {0}) THEN 2 * count_if(score > 50) FILTER (WHERE prompt = {0}) > count(*) FILTER (WHERE prompt = {0}) END AS feature_{0}"


@query(f"WITH s AS ({SCORES}) SELECT paper_id, model, {', '.join(_VOTE.format(k) for k in range(3))} FROM s GROUP BY ALL")
def verdict_matrix(spark, sf_dir):
    """Verdicts of each paper and judge, a column for each feature; ties are no verdict."""
    v = scores(spark, sf_dir).groupBy("paper_id", "model").pivot("prompt", [0, 1, 2]).agg(J.majority(F.count_if(F.col("score") > 50), F.count(F.lit(1))))
    return v.select("paper_id", "model", *[F.col(str(k)).alias(f"feature_{k}") for k in range(3)])


@query(f"""WITH s AS ({SCORES}), y AS (SELECT prompt, year, avg(score) AS mean FROM s GROUP BY ALL),
z AS (SELECT prompt, year, round((mean - avg(CASE WHEN year <= 10 THEN mean END) OVER w) / nullif(stddev_samp(CASE WHEN year <= 10 THEN mean END) OVER w, 0), 6) AS z FROM y WINDOW w AS (PARTITION BY prompt))
SELECT year, a.z AS z_0, b.z AS z_1, c.z AS z_2 FROM (SELECT year, z FROM z WHERE prompt = 0) a JOIN (SELECT year, z FROM z WHERE prompt = 1) b USING (year) JOIN (SELECT year, z FROM z WHERE prompt = 2) c USING (year)""")
def prompt_z_by_year(spark, sf_dir):
    """The z series of each prompt side by side, for years that all of them have."""
    y = scores(spark, sf_dir).groupBy("prompt", "year").agg(F.avg("score").alias("mean"))
    z = y.withColumn("z", F.round(K.baseline_z("mean", F.col("year") <= 10, "prompt"), 6))
    wide = z.groupBy("year").pivot("prompt", [0, 1, 2]).agg(F.first("z"))
    return wide.select("year", *[F.col(str(k)).alias(f"z_{k}") for k in range(3)]).dropna()


@query(f"WITH s AS ({SCORES}) SELECT prompt AS feature, count(DISTINCT model) AS n_models FROM s GROUP BY prompt HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM s)")
def common_features(spark, sf_dir):
    """Features that every judge has scored."""
    s = scores(spark, sf_dir).select(F.col("prompt").alias("feature"), "model").distinct()
    n = s.groupBy("feature").agg(F.count(F.lit(1)).alias("n_models"))
    return n.join(F.broadcast(s.agg(F.countDistinct("model").alias("all"))), F.col("n_models") == F.col("all")).drop("all")  # one row


@query(f"WITH s AS ({SCORES}) SELECT DISTINCT year FROM s")
def score_years(spark, sf_dir):
    """All years that any judge has scored."""
    return scores(spark, sf_dir).select("year").distinct()


@query(rf"SELECT doc_id, length(substr(text, 1, 8000)) AS n_chars, md5(substr(text, 1, 8000)) AS digest FROM documents WHERE {_WORDS.format('text')} >= 5")
def guarded_texts(spark, sf_dir):
    """Texts of five words or more, at the 8000 characters that the parser metrics read: the limit is the feature."""
    text = F.substring("text", 1, 8000)
    d = table(spark, sf_dir, "documents").where(F.size(T.tokens(F.col("text"))) >= 5)
    return d.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


_ELIGIBLE = "SELECT paper_id, year, CASE WHEN paper_id % 7 <> 0 THEN citations END AS citations, CASE WHEN paper_id % 11 <> 0 THEN subfield END AS arxiv_id FROM ({0})"


@query(f"SELECT * FROM ({_ELIGIBLE.format(OUTCOMES)}) WHERE citations IS NOT NULL AND arxiv_id IS NOT NULL")
def eligible_papers(spark, sf_dir):
    """Papers that may be drawn: those with citations and an identifier."""
    o = outcomes(spark, sf_dir)
    o = o.select("paper_id", "year", F.when(F.col("paper_id") % 7 != 0, F.col("citations")).alias("citations"), F.when(F.col("paper_id") % 11 != 0, F.col("subfield")).alias("arxiv_id"))
    return o.dropna(subset=["citations", "arxiv_id"])


@query("""WITH b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 100 = 0 THEN 0.01 ELSE 0.0 END AS o_totalprice FROM orders)
SELECT false AS ok, count(*) AS n_ref, count(*) AS n_built, count_if(abs(a.o_totalprice - b.o_totalprice) > 1e-9)::BIGINT AS n_off, 'o_orderstatus' AS lacking FROM orders a JOIN b USING (o_orderkey)""")
def verify_numbers(spark, sf_dir):
    """A rebuilt table against its reference, number by number; one column of the reference is lacking."""
    ref = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    more = F.when(F.col("o_orderkey") % 100 == 0, 0.01).otherwise(0.0)
    return S.same_numbers(ref, ref.select("o_orderkey", (F.col("o_totalprice") + more).alias("o_totalprice")), ["o_orderkey"], atol=1e-9)


@query("""SELECT page_id AS paper_id, 1990 AS year, url AS title, NULL::VARCHAR AS abstract FROM pages UNION ALL BY NAME
SELECT doc_id AS paper_id, 2021 AS year, text AS abstract FROM documents""")
def schema_union(spark, sf_dir):
    """Records of two schemas as one; what one of them lacks is null."""
    old = table(spark, sf_dir, "pages").select(F.col("page_id").alias("paper_id"), F.lit(1990).alias("year"), F.col("url").alias("title"))
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.lit(2021).alias("year"), F.col("text").alias("abstract"))
    return old.unionByName(new, allowMissingColumns=True)


@query("SELECT doc_id, length(html) AS n_chars, html IS NULL AS absent FROM documents LEFT JOIN pages ON doc_id = page_id")
def fulltext_by_key(spark, sf_dir):
    """The full text of each paper by its key, null where there is none."""
    d, p = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "pages")
    # A generator holds the length below the join, so that no page is shuffled.
    p = p.select("page_id", F.explode(F.array(F.length("html").cast("long"))).alias("n_chars"))
    at = d.join(p, F.col("doc_id") == F.col("page_id"), "left")
    return at.select("doc_id", "n_chars", F.col("n_chars").isNull().alias("absent"))


@query()
def tier1_rows(spark, sf_dir):
    """The plain rubric features of each text in one row."""
    from scriptorium.functions import rubric as B

    at = papers(spark, sf_dir).withColumn("text", F.expr(texts.CUED))
    at = at.withColumn("text", F.expr(texts._PROOF.replace("doc_id", "paper_id")))  # so that other classes than hedged occur
    at = at.withColumn("sentences", B.split_sentences(F.col("text")))
    at = at.select("paper_id", "venue", "year", B.concrete_number(F.col("text")).alias("concrete_number"), B.claim_strength(B.claim_counts(F.col("text"))).alias("claim_strength"), B.label_roles(F.col("sentences")).alias("roles"))
    return at.withColumns({"claim_strength_ord": B.claim_ordinal(F.col("claim_strength")), "role_sequence_dist": B.template_distance(F.col("roles"))})


_RAW = """CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'Paper ' || doc_id END AS title, CASE WHEN doc_id % 11 = 0 THEN 'only four words here' ELSE text END AS abstract,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE source END AS authors"""


def _ingested(spark, sf_dir):
    from scriptorium.sources import stages

    d = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.concat(F.lit("Paper "), F.col("doc_id")))
    abstract = F.when(F.col("doc_id") % 11 == 0, "only four words here").otherwise(F.col("text"))
    authors = T.parse_authors(F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("source")))
    raw = d.select((1987 + F.col("doc_id") % 39).cast("int").alias("year"), F.col("doc_id").cast("string").alias("id"), title.alias("title"), abstract.alias("_a"), authors.alias("_b"), F.lit(None).cast("string").alias("source_id"), "lang")
    return stages.ingest_counted(raw, "neurips", F.col("_a"), F.col("_b"), {"category": F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))})


@query(rf"""WITH r AS (SELECT doc_id, {_RAW} FROM documents),
w AS (SELECT CASE WHEN trim(title) = '' THEN 'no_title' WHEN len(list_filter(regexp_split_to_array(abstract, '\s+'), lambda x: x <> '')) < 5 THEN 'short_abstract' WHEN authors = '' THEN 'no_authors' END AS why FROM r)
SELECT count(*) AS n_read, count(*) FILTER (why IS NULL) AS n_kept, count(*) FILTER (why = 'no_title') AS no_title, count(*) FILTER (why = 'short_abstract') AS short_abstract,
  count(*) FILTER (why = 'no_authors') AS no_authors FROM w""")
def ingest_report(spark, sf_dir):
    """What an ingest read, kept and skipped, counted in the pass that wrote it and read back from its report."""
    from scriptorium.sources import stages
    from scriptorium.sources.scratch import new_path

    kept, seen = _ingested(spark, sf_dir)
    report = new_path(spark, "ingest-report")
    stages.written_with_report(kept, seen, new_path(spark, "ingested"), report)
    names = ("n_read", "n_kept", *stages.REASONS)
    return spark.read.schema(", ".join(f"{c} long" for c in names)).json(report)


_VENUES = [*(f"src{i}" for i in range(1, 8)), "none"]


@query(r"""WITH p AS (SELECT doc_id, (1987 + doc_id % 39)::INT AS year, source AS venue, length(text) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'none')),
k AS (SELECT doc_id FROM labels WHERE quality = 0 AND (1987 + doc_id % 39) >= 2015)
SELECT year || '_' || doc_id AS paper_id, year, venue, n FROM p SEMI JOIN k USING (doc_id)""")
def keyed_papers(spark, sf_dir):
    """Papers of seven venues by their keys, from a table in folders by venue and year; keys name years from 2015 on."""
    from scriptorium.sources import stages
    from scriptorium.sources.scratch import new_path
    from scriptorium.sources.tables import write_partitioned

    key = lambda c: F.concat_ws("_", (1987 + F.col(c) % 39).cast("string"), F.col(c).cast("string")).alias("paper_id")
    path = new_path(spark, "papers")
    write_partitioned(papers(spark, sf_dir).select(key("paper_id"), "venue", "year", F.length("text").alias("n")).where(F.col("venue").isin(_VENUES)).repartition("venue", "year"), path)
    keys = table(spark, sf_dir, "labels").where("quality = 0 AND (1987 + doc_id % 39) >= 2015").select(key("doc_id"))
    return stages.find_all(spark, path, keys).where(F.col("venue").isin(_VENUES)).select("paper_id", "year", "venue", "n")


def _last_letter(text: str) -> str:
    """Fails on an empty text."""
    return text[-1]


def _vowels(text: str) -> int:
    if text.startswith("T"):
        raise ValueError("starts with T")
    return sum(map(text.count, "aeiou"))


@query(r"""SELECT doc_id, length(text) AS n_chars_, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words,
  CASE WHEN NOT starts_with(text, 'T') THEN length(regexp_replace(text, '[^aeiou]', '', 'g')) END AS vowels, right(text, 1) AS last_letter,
  CASE WHEN starts_with(text, 'T') THEN 'vowels: ValueError: starts with T' ELSE '' END AS failed FROM documents""")
def metric_rows(spark, sf_dir):
    """Two metrics that are expressions and two that are functions, in one scan; one of these fails on some texts."""
    from scriptorium.functions.metrics import Metric, apply

    metrics = [
        Metric("n_chars_", lambda c: F.length(c).cast("long")),
        Metric("n_words", lambda c: F.size(T.tokens(c)).cast("long")),
        Metric("vowels", function=_vowels, kind="long"),
        Metric("last_letter", function=_last_letter, kind="string"),
    ]
    at = apply(table(spark, sf_dir, "documents"), "text", metrics, ["doc_id"])
    failed = F.array_join(F.transform("errors", lambda e: F.concat(e.metric, F.lit(": "), e.error)), "; ")
    return at.select("doc_id", *[m.name for m in metrics], failed.alias("failed"))
