"""Steps that several others read are computed once, and cheap guards lose no match."""

from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.functions import text as C
from regspark.operators import refs as R
from regspark.operators import segment as S


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_on_length_computes_the_body_once(spark):
    docs = spark.createDataFrame([("d", "Art. 1. Uno.\n" + "x" * 120)], "doc string, text string")
    plan = optimized(S.real_articles(S.plain_articles(docs)))
    assert plan.count("REVISI") == optimized(S.plain_articles(docs)).count("REVISI")


def test_pages_are_cut_a_few_times_only(spark):
    pages = spark.range(4).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.concat(F.lit("Art. "), "id", F.lit(". Uno.\n")).alias("text"))
    assert optimized(S.plain_articles_of_pages(pages, 0)).count("Range (") <= 4


def test_images_are_looked_for_in_articles_that_name_one(spark):
    a = spark.createDataFrame([("s", 1, "1", "t", "a [IMAGEN_1] b", "", ""), ("s", 2, "2", "t", "none here at all", "", "")],
                              "source string, pos int, number string, title string, block string, context_code string, chapter string")
    m = spark.createDataFrame([("s", "IMAGEN_1", "u")], "source string, img_key string, url string")
    parts = S.article_parts(a)
    assert [tuple(r) for r in S.useful_images(parts, m, 3).collect()] == [("s", 1, ["[IMAGEN_1]"], ["u"])]
    assert "[IMAGEN_" in optimized(S.useful_images(parts, m, 3))


ODD = ["", "art. 3 de la presente NORMATIVA", "ART 4 DE LA CONſTITUCIÓN y art. 5 de la constıtución", "artículo 6.1 de su REGLAMENTO; art. 7 de la Ley 9/2002",
       "art. 8 del real  DECRETO, art 9 LSG", "SEGÚN el art. 10, conforme al art. 11, ſegún el art. 12", 'art. 13 de la "Ley 3/1999', "prevıſto en el art. 14",
       "aRt. 15 de la LEY 1/1 atenderá al art. 16", "según en el art. 17 eſtablecido al art. 18", None]


def test_guards_of_references_lose_no_match(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    got = {r.i: sorted((x.pattern, x.pos, x.number) for x in r.c or []) for r in d.select("i", R.reference_candidates("t").alias("c")).collect()}
    want = {i: [] for i in range(len(ODD))}
    for k, (_, _, p) in enumerate(X.REFERENCES):
        regex = "(?iu)" + p.replace("{acr}", "((?-i:[A-Z]{2,10}))")
        for r in d.select("i", C.matches(F.col("t"), regex, 1).alias("n")).collect():
            want[r.i] += [(k, j, n) for j, n in enumerate(r.n or [])]
    assert got == {i: sorted(v) for i, v in want.items()}


def test_contexts_are_those_of_the_whole_text(spark):
    texts = ["LSG", "a" * 200 + "lsg" + "b" * 30 + "LsG" + "c" * 300, "x" * 49 + "LSG" + "y" * 120 + "LSG" + "z" * 51, "none", "", "LSGLSG" + "q" * 60 + "lSG",
             "á" * 70 + "\nLSG\n" + "é" * 70 + "ſLSG"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.contexts for r in R.contexts(d, "t", "LSG", 50, 9).collect()}
    want = {r.i: r.w for r in d.select("i", C.matches(F.col("t"), r"(?is).{0,50}LSG.{0,50}").alias("w")).collect() if r.w}
    assert got == want


def test_footers_without_their_words_stay(spark):
    texts = ["3 de 4", "REVISIÓN DEL a\nb ataDx", "OFICINA DE PLANEAMIENTO y 2025z", "S.E.P.I.A. q\nr", "onalletsac\ns", "3de 4", "", None, "12 de 691 y de"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t")
    for pattern, dotall in X.FOOTERS:
        plain = F.regexp_replace(plain, ("(?s)" if dotall else "") + pattern, "")
    assert all(r.a == r.b for r in d.select(C.remove_footers("t").alias("a"), plain.alias("b")).collect())
