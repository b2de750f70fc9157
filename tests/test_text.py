"""Scalar text functions on edge inputs."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import acronyms as A
from scriptorium.functions import judge as J
from scriptorium.functions import readability as R
from scriptorium.functions import rubric as B
from scriptorium.functions import text as T


def one(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_sanitize(spark):
    assert one(spark, T.sanitize, " a\x00b \t\n c ", None, "") == ["ab c", "", ""]
    assert one(spark, lambda c: T.sanitize(c, True), "é") == ["é"]


def test_preprocess(spark):
    got = one(spark, T.preprocess, "METHODS: a = b ( c )", "abstraction ABSTRACT: x", "Abstract. We", "p &lt; 3 +/- 1", "claim: y")
    assert got == ["a equal to b (c)", "abstraction x", "We", "p less than 3 plus or minus 1", "cl y"]


def test_counts(spark):
    assert one(spark, T.hedging, "It may possibly seem. Seems likely; further studies", "Maybe", "mayor") == [6, 1, 0]
    assert one(spark, T.signposting, "However, in turn, after that. Beforehand next") == [5]
    assert one(spark, T.has_narrator, "We show", "US law", "thus", "Us too") == [1, 0, 0, 1]
    assert one(spark, T.sentence_stops, "One. Two. Three.", "none", "") == [3, 1, 1]
    assert one(spark, lambda c: T.hype(T.hype_words(c))["hype_scale"], "multi-disciplinary and multidisciplinary, vast") == [3]


def test_clean_ocr(spark):
    year = F.lit(1990)
    got = one(spark, lambda c: T.clean_ocr(c, year), "12 TITLE OF IT. Now this is a sentence of prose here. More.", "(cid:7) ABSTRACT: hi  there", "ABSTRACT")
    assert got == ["Now this is a sentence of prose here. More.", "hi there", "ABSTRACT"]
    long = "This is one sentence with ten words right in it. " * 50
    assert one(spark, lambda c: T.clean_ocr(c, year), long)[0] == ("This is one sentence with ten words right in it. " * 35).strip()
    assert one(spark, lambda c: T.clean_ocr(c, F.lit(2010)), long)[0] == long.strip()


def test_best_abstract(spark):
    rows = spark.createDataFrame([("Abstract Unavailable", "w " * 700), ("short", "few"), (None, None)], "a string, f string")
    got = [r.x for r in rows.select(T.best_abstract(F.col("a"), F.col("f"), F.lit(2010)).alias("x")).collect()]
    assert [len(x.split()) for x in got] == [600, 1, 0]


@pytest.mark.parametrize("w, yes", [("WHO", True), ("Who", False), ("RNA2", True), ("R2", False), ("mRNA", True), ("DNAs", True)])
def test_is_acronym(spark, w, yes):
    assert one(spark, A.is_acronym, w) == [yes]


def test_acronym_lists(spark):
    words = lambda c, abstract: A.acronyms(A.masked_words(c, abstract))
    assert one(spark, lambda c: words(c, False), "The W.H.O. and DNAs of mice", "ALL CAPS TITLE HERE", "One") == [["WHO", "DNA"], [], []]
    got = one(spark, lambda c: words(c, True), "We use RNA and XX in 5 mg/dl of METHODS: BERT", "A BB CC DD EE run of caps in here with other words too and more")
    assert got == [["RNA", "BERT"], []]


def test_concrete_number(spark):
    texts = ["gains of 3.5%", "in 1987 we", "n = 5", "dimension = 5", "2x faster", "× 4", "5 modelsx", "3 models"]
    assert one(spark, B.concrete_number, *texts) == [True, False, True, True, True, True, False, True]


def test_claim_strength(spark):
    f = lambda c: B.claim_strength(B.claim_counts(c))
    texts = ["We prove a theorem.", "It may likely.", "nothing", "There exists a proof", "across 13 models"]
    assert one(spark, f, *texts) == ["guarantee", "hedged", "hedged", "hedged", "systematic"]


def test_sentences(spark):
    got = one(spark, B.split_sentences, "One is here. Two, e.g. Three is not. Four!", "", "See Fig. 3 now. End")
    assert got == [["One is here.", "Two, e.g. Three is not.", "Four!"], [], ["See Fig. 3 now.", "End"]]


def test_roles(spark):
    text = "Models are trained widely. However, little is known. We propose a cure. Experiments show accuracy. We release code."
    assert one(spark, lambda c: B.label_roles(B.split_sentences(c)), text, "") == ["SGCEI", ""]
    assert one(spark, B.template_distance, "SSGGCCEI", "", "C") == [0, 5, 4]


def test_jargon(spark):
    assert one(spark, lambda c: B.jargon_density(c, ["the", "deep"]), "the deep-net RNA zorb", "") == [0.25, 0.0]


def test_readability(spark):
    rows = spark.createDataFrame([("The cat sat on the mat. It was a very good day for cats.",), ("too short",), ("",)], "t string")
    at = rows.select("t", *[c.alias(k) for k, c in R.counts(F.col("t")).items() if k != "syl"]).withColumn("syl", F.transform("words", R.syllables))
    got = at.select(*[c.alias(k) for k, c in R.scores().items()]).collect()
    assert (got[0].word_count, got[0].sentence_count, got[0].syllable_count) == (14, 2, 15)
    assert got[0].flesch_ease == pytest.approx(206.835 - 1.015 * 7 - 84.6 * 15 / 14, abs=1e-3)
    assert got[1].flesch_ease is None and got[2].forcast is None


def test_parse(spark):
    assert one(spark, J.parse_score, "Score: 4", "Score: 5.9", "Score: 10", "it is 3 of", "7", "1987", None) == [4.0, 5.9, 1.0, 3.0, None, None, None]
    assert one(spark, lambda c: J.parse_int_score(c, "Claims", 0, 10), "Claims: 12", "3 and 4", "-2", "no") == [None, 3, None, None]
    got = one(spark, J.parse_verdict, 'ok {"value": True, "evidence": "a } b"} x', '{"value": "yes"}', '{"value": tr', "none", '{"value": false}')
    assert [(g.value, g.evidence) if g else None for g in got] == [(True, "a } b"), None, None, None, (False, "")]


def test_evidence(spark):
    got = one(spark, lambda c: J.verify_evidence(F.lit("Some  Text\nhere"), c), "text HERE", "", None, "absent")
    assert got == [True, False, False, False]


def test_titles(spark):
    assert one(spark, T.normalize_title, "Café \\alpha: A-b!", None) == ["cafe a b", ""]
    assert one(spark, T.arxiv_id, "arxiv.org/abs/2101.12345v2", "arXiv:hep-th/0123456", "no") == ["2101.12345", "hep-th/0123456", None]
    assert one(spark, T.section_name, "3. Experimental Results", "IV Prior Work", None, "Foo") == ["experiments", "related_work", "other", "other"]
    assert one(spark, T.flip_author, "Doe, Jane", "Jane Doe") == ["Jane Doe", "Jane Doe"]


def test_tags(spark):
    tags = F.array(*map(F.lit, ["NOUN", "NOUN", "NOUN", "NOUN", "VERB", "NUM"]))
    got = spark.range(1).select(*[c.alias(k) for k, c in J.noun_chains(tags).items()], J.tree_depth(F.array(F.lit(1), F.lit(1), F.lit(0))).alias("d")).first()
    assert tuple(got) == (1, 4, 1, 1, 2)


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cleaned_ocr_is_made_once(spark):
    assert planned(spark.createDataFrame([("x", 1)], "t string, y int").select(T.clean_ocr(F.col("t"), F.col("y")).alias("x"))).count("cid") == 1
    cases = [("12 TITLE OF IT. Now this is a sentence of prose here. " + "Word and word again here now. " * 80, y) for y in (2000, 2010, None)] + [(None, 2000), ("", 2000)]
    got = [r[0] for r in spark.createDataFrame(cases, "t string, y int").select(T.clean_ocr(F.col("t"), F.col("y"))).collect()]
    assert got[0].startswith("Now this") and got[0].endswith("now.") and len(got[0].split()) <= 350 and got[1] == got[2] == cases[1][0].strip() and got[3:] == [None, ""]


def test_masked_words_are_made_once(spark):
    df = spark.createDataFrame([("the BACKGROUND: of a (DNA) model here", 1)], "t string, y int")
    assert planned(df.select(A.masked_words(F.col("t"), True).alias("x"))).count("MicroRNA") == 1
    assert df.select(A.masked_words(F.col("t"), True)).first()[0] == ["the", "dummy", "of", "a", "DNA", "model", "here"]


def test_claim_counts_are_made_once(spark):
    from scriptorium.functions import rubric as B

    df = spark.createDataFrame([("we prove that it may hold; a theorem", 1)], "t string, y int")
    at = df.select(B.claim_strength(B.claim_counts(F.col("t"))).alias("s"))
    assert planned(at).count("theorem") == 1 and at.first().s == "guarantee"
