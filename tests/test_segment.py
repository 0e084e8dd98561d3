"""Segmentation on texts with the known edge shapes, with and without the compatible behaviour."""


from pyspark.sql import functions as F

from regspark.functions import features as FE
from regspark.functions import text as C
from regspark.operators import refs as R
from regspark.operators import segment as S

MD = """## CAPÍTULO II Suelo urbano 12

## Ordenanza U3.A edificación

## Art. 1. Altura

Breve.

| a | b |
|---|---|
| 1 | 2 |

La altura máxima será de tres plantas sobre la rasante.

## Articulo 2: Usos

El uso residencial queda permitido en todo el ámbito.

## CAPÍTULO III Otro

## Artículo 3. Solo

Un único párrafo con [IMAGEN_1] y [IMAGEN_2] dentro del texto.

## ANEXO I

Texto del anexo primero.

## ANEXO II

Texto del anexo segundo.

## ANEXO I

Repetido dentro del segundo.
"""


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, md string")


def test_articles_context_and_annexes(spark):
    d = docs(spark, ("n", MD))
    a = {r["number"]: r for r in S.markdown_articles(d).collect()}
    assert set(a) == {"1", "2", "3"}
    assert a["1"]["chapter"] == "II Suelo urbano 12" and a["1"]["context_code"] == "U3.A"
    assert a["3"]["chapter"] == "III Otro" and a["3"]["context_code"] == "U3.A"  # a chapter does not reset the ordinance
    assert "anexo" not in a["3"]["block"]
    c = {r["number"]: r for r in S.markdown_articles(d, compat=True).collect()}
    assert set(c) == {"1", "2"} and "anexo primero" in c["2"]["block"]
    x = {r["number"]: r["block"] for r in S.markdown_annexes(d).collect()}
    assert set(x) == {"Anexo-I", "Anexo-II"} and "Repetido" in x["Anexo-II"]


def test_chunks_keep_index_tables_and_images(spark):
    images = spark.createDataFrame([("n", "IMAGEN_1", "http://i/1"), ("n", "IMAGEN_2", "http://i/2"), ("n", "IMAGEN_3", "http://i/2")],
                                   "source string, img_key string, url string")
    rows = S.chunks(S.markdown_articles(docs(spark, ("n", MD))), images, max_frequency=1).collect()
    by = {(r["article_no"], r["paragraph_no"]): r for r in rows}
    assert set(by) == {("1", 1), ("2", 0), ("2", 1), ("3", 0)}  # a chapter heading stays in the text before it
    one = by[("1", 1)]  # the first paragraph is too short, its table goes to the first kept chunk
    assert one["has_tables"] and one["chunk_kind"] == "parrafo" and one["defines_height"] and one["text_with_header"].endswith("| 1 | 2 |\n")
    assert one["header"] == "ORDENANZA U3.A | II Suelo urbano | Art. 1 | Altura | [altura]"
    assert by[("3", 0)]["raw_images"] == ["[IMAGEN_1]"] and by[("3", 0)]["image_urls"] == ["http://i/1"]
    assert one["ordinance"] == "U3" and len(one["chunk_id"]) == 12
    lost = S.chunks(S.markdown_articles(docs(spark, ("n", MD))), images, 1, compat=True).filter("has_tables").count()
    assert lost == 0


def test_coded_sections_and_fallback(spark):
    coded = "## Sección SI 1 Propagación interior\ntexto\n## Sección SI 2 Exterior\nmás"
    plain = "## 1 Generalidades del documento\nuno\n## Anejo a Terminología común\ndos\n## 1 Generalidades del documento\ntres"
    rows = {(r["source"], r["number"]): r["block"] for r in S.coded_sections(docs(spark, ("c", coded), ("p", plain))).collect()}
    assert rows == {("c", "SI 1"): "texto", ("c", "SI 2"): "más", ("p", "1"): "uno", ("p", "Anejo-A"): "dos"}


def test_plain_articles(spark):
    body = "1. Primer apartado del artículo con suficiente texto.\n2) Segundo apartado.\na) Letra del segundo apartado, algo más larga."
    text = ("TÍTULO IV. Normas\nCAPÍTULO II. Suelo\nArt. 1. Índice.\ncorto\nArt. 1. Régimen\ndel suelo.\n" + body +
            "\n12 de 691\nArt. 2. Otro.\n" + "Texto simple sin apartados. " * 6 + "\nArt. 2. Otro.\n" + "Repetido. " * 20)
    a = S.plain_articles(spark.createDataFrame([("d", text)], "doc string, text string"))
    real = {r["number"]: r for r in S.real_articles(a).collect()}
    assert real["1"]["heading"] == "Régimen del suelo" and real["1"]["title"]["number"] == "IV" and "de 691" not in real["1"]["body"]
    assert sorted((r["number"], r["reason"]) for r in S.dropped_articles(a).collect()) == [("1", "short"), ("2", "duplicate")]
    p = {r["number"]: r["s"] for r in S.real_articles(a).select("number", S.numbered_paragraphs("body").alias("s")).collect()}
    assert [i["number"] for i in p["1"]["paragraphs"]] == ["1", "2", "a"] and p["2"]["kind"] == "simple"


def test_long_lines_do_not_exhaust_the_regex_stack(spark):
    title = "\n".join(["linea de un titulo muy largo sin punto"] * 20_000)
    table = "| a | b |\n" * 30_000
    d = spark.createDataFrame([("d", f"Art. 1. {title}.\n" + "cuerpo " * 40)], "doc string, text string")
    assert S.plain_articles(d).select("chars").first()["chars"] > 100
    parts = S.article_parts(S.markdown_articles(docs(spark, ("n", "## Art. 1. T\n\n" + table + "\nfin del texto"))))
    assert len(parts.first()["tables"]) == 1


def test_glued_headings(spark):
    df = spark.createDataFrame([("## CondicionesMinimas x",), ("## ANEXO I",)], "h string")
    rows = df.select(C.split_glued_heading("h").alias("a"), C.split_glued_heading("h", compat=True).alias("b")).collect()
    assert [r["a"] for r in rows] == ["## Condiciones Minimas x", "## ANEXO I"] and rows[1]["b"] == "## ANEX O I"


def test_references_and_quirks(spark):
    text = "según el art. 44.6 de la Ley 22/1988, art. 103 LSG; art. 5 de la Constitución y el art. 9 de noviembre, conforme al art. 103"
    a = spark.createDataFrame([("d", "1", text)], "doc string, number string, body string")
    got = {r["ref_number"]: (r["ref_source"], r["priority"]) for r in R.extract_references(a, ["doc", "number"], "body").collect()}
    assert got["44.6"] == ("Ley 22/1988", 2) and got["103"] == ("LSG", 2) and got["5"] == ("Constitución", 1) and "9" not in got
    listed = R.reference_list(R.extract_references(a, ["doc", "number"], "body"), ["doc", "number"]).first()["refs"]
    assert [x["number"] for x in listed] == ["5", "44.6", "103"]
    compat = {r["ref_number"] for r in R.extract_references(a, ["doc", "number"], "body", compat=True).collect()}
    assert compat >= set(got)


def test_wikilinks_drop_unknown_articles(spark):
    notes = spark.createDataFrame([("s", 1, "ver Art. 3.1 y Art. 4"), ("s", 2, "Art. 99"), ("s", 3, "sin cita")], "source string, note_id int, ref string")
    slugs = spark.createDataFrame([("s", "art-3-1"), ("s", "art-4")], "source string, slug string")
    assert {r["note_id"]: r["linked"] for r in R.wikilinks(notes, slugs).collect()} == {1: "ver [[art-3-1]] y [[art-4]]", 3: "sin cita"}


def test_expansion_order_and_word_boundary(spark):
    words = [("local", ["bajo comercial", "local comercial"]), ("altura", ["plantas"])]
    df = spark.createDataFrame([("localizar la altura",), ("local comercial",), ("nada",)], "q string")
    rows = df.select(FE.expand_query("q", words).alias("a"), FE.expand_query("q", words, whole_words=True).alias("b")).collect()
    assert rows[0]["a"] == "localizar la altura bajo comercial local comercial plantas" and rows[0]["b"] == "localizar la altura plantas"
    assert rows[1]["a"] == "local comercial bajo comercial" and rows[2]["a"] == "nada"


def test_chunk_text_reassembles(spark):
    parts = S.article_parts(S.markdown_articles(docs(spark, ("n", MD)))).collect()
    for p in parts:
        for paragraph in p["paragraphs"]:
            for line in paragraph.replace("[TABLA]", "").split("\n"):
                assert line in p["clean_block"].replace("[IMAGEN_1]", "").replace("[IMAGEN_2]", "")


def test_pack_blocks(spark):
    df = spark.createDataFrame([("\n\n".join(["x" * 150] * 4 + ["y" * 60]),)], "t string")
    packed = df.select(S.pack_blocks("t").alias("b")).first()["b"]
    assert [len(b) for b in packed] == [454, 212]


def test_page_route_equals_document_route(spark, sf):
    from regspark.plans import derive as D

    pages = D.shared(spark, sf, "page_texts")
    cols = ["doc", "number", "heading", "body", "title", "chapter", "section"]
    whole = S.plain_articles(S.join_pages(pages)).select(*cols)
    paged = S.plain_articles_of_pages(pages).select(*cols)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, paged.collect())) == sorted(map(key, whole.collect()))


def test_heading_across_a_page_border(spark):
    rows = [("d", 7, "CAPÍTULO II. Suelo\nArt. 1. Uno.\ncuerpo uno\nArt. 2. Título que"), ("d", 8, "sigue en la otra página.\ncuerpo dos"),
            ("d", 9, "continúa dos\nArt. 3"), ("d", 10, "fin sin artículo")]
    pages = spark.createDataFrame(rows, "doc string, page int, text string")
    cols = ["number", "heading", "body", "chapter"]
    whole = sorted(map(tuple, S.plain_articles(S.join_pages(pages)).select(*cols).collect()))
    assert sorted(map(tuple, S.plain_articles_of_pages(pages).select(*cols).collect())) == whole
    assert [w[1] for w in whole] == ["Uno", "Título que sigue en la otra página"]


def test_corpus_routes_by_kind_of_source(spark):
    from regspark.plans import ingest

    code = "## Sección SI 1 Propagación interior\nEl texto de la sección fija la altura máxima."
    c = ingest.chunk_corpus(docs(spark, ("norma", MD), ("cte-si", code)))
    got = {(r["source"], r["article_no"]) for r in c.collect()}
    assert {("cte-si", "SI 1"), ("norma", "1"), ("norma", "3"), ("norma", "Anexo-I"), ("norma", "Anexo-II")} <= got


def test_pages_equal_the_document_wherever_headings_are_cut(spark):
    """Headings over any number of pages, blank pages and repeated open heads give the articles of the whole document."""
    import random

    rnd = random.Random(5)
    lines = ["Art. 1. Titulo uno.", "cuerpo. con puntos.", "Art.", "2.", "Titulo que", "sigue en otra", "y acaba aqui. cuerpo dos", "Art. 3", ". Otro", "", "sin punto", "TITULO I. Cosas", "Art. 4b.", "fin."]
    docs = {0: ["nada.", "Art. 1. Uno.", "cuerpo uno. Art. 2. Titulo que", "sigue en esta pagina entera", "y acaba aqui. cuerpo dos"]}
    for d in range(1, 40):
        docs[d] = ["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 12))]
    pages = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc int, page int, text string")
    whole = S.plain_articles(S.join_pages(pages, 0))
    cols = ["doc", "number", "heading", "full_title", "body", "chars", "title", "chapter", "section"]

    def in_order(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r.doc, r.pos)):
            out.setdefault(r.doc, []).append(tuple(r[c] for c in cols))
        return out

    by_page = in_order(S.plain_articles_of_pages(pages, 0))
    assert by_page == in_order(whole)
    assert [r[1] for r in by_page[0]] == ["1", "2"]


def test_headings_are_carried_inside_arrays(spark):
    from regspark.functions import text as C

    values = [None, "a", None, None, "b", "c", None] * 40
    df = spark.createDataFrame([(values,), ([],), ([None],), (["x"],)], "v array<string>")
    got = [r.c for r in df.select(C.carried(F.col("v"), 16).alias("c")).collect()]
    want, last = [], None
    for v in values:
        want.append(last)
        last = v or last
    assert got == [want, [], [None], [None]]


def test_html_text_after_a_nested_block_stays_with_the_outer_block(spark):
    html = "<div>art. 1<p>x y</p>COLA del bloque</div>fuera<p>art. 2</p><div><div>hondo de verdad</div> cola dos larga</div>"
    rows = S.html_blocks(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).orderBy("pos").collect()
    assert [(r.tag, r.text.strip()) for r in rows] == [("div", "art. 1"), ("p", "x y"), ("div", "COLA del bloque"), ("p", "art. 2"), ("div", "hondo de verdad"), ("div", "cola dos larga")]
    got = S.html_articles(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string"), ["art."]).orderBy("article").collect()
    assert [(r.title.strip(), [c.strip() for c in r.content]) for r in got] == [("art. 1", ["COLA del bloque"]), ("art. 2", ["hondo de verdad", "cola dos larga"])]
    assert S.html_articles(spark.createDataFrame([(1, "u", "<p>Artículo 5 de prueba</p><p>texto bastante largo</p>")], "page_id int, url string, html string")).count() == 1


def test_chunks_with_equal_ids_stay_rows(spark, sf, monkeypatch):
    from regspark.plans import catalog

    catalog.load_all()
    query = catalog.QUERIES["t13_t14_chunk_kind_and_id"]
    want = query(spark, sf).count()
    monkeypatch.setattr(S, "chunk_id", lambda *_: F.lit("0123456789ab"))
    rows = query(spark, sf).collect()
    assert len(rows) == want and {r.n for r in rows} == {1}
