"""Readers, sinks and service answers on small files written by the tests."""

import json


from regspark.operators import segment as S
from regspark.sources import cadastre, readers, sinks


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_markdown_corpus_keeps_registered_files(spark, tmp_path):
    write(tmp_path / "md" / "a.md", "## Art. 1. Uno\n\nTexto")
    write(tmp_path / "md" / "b.md", "sin registrar")
    reg = spark.createDataFrame([("norma", "a.md", 3)], "source string, file_name string, max_frequency int")
    rows = readers.markdown_corpus(spark, str(tmp_path / "md"), reg).collect()
    assert [(r["source"], r["md"].split("\n")[0], r["max_frequency"]) for r in rows] == [("norma", "## Art. 1. Uno", 3)]


def test_article_json_round_trip(spark, tmp_path):
    doc = {"metadata": {"total_articulos": 1}, "articulos": [{"numero": "7", "titulo": "Art. 7. Cosa.", "contenido": "x",
           "contexto": {"titulo": {"numero": "I", "nombre": "Normas"}, "capitulo": None, "seccion": None}}]}
    write(tmp_path / "a.json", json.dumps(doc))
    r = readers.article_json(spark, str(tmp_path / "a.json")).first()
    assert (r["numero"], r["contexto"]["titulo"]["nombre"], r["contexto"]["capitulo"]) == ("7", "Normas", None)


def test_converted_markdown_paths(spark):
    raws = ['{"document":{"md_content":"a"}}', '{"output":{"markdown":"b"}}', '{"markdown":"c"}', '{"other":"' + "z" * 3000 + '"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    out = [r["m"] for r in df.select("i", readers.converted_markdown("raw").alias("m")).orderBy("i").collect()]
    assert out[:3] == ["a", "b", "c"] and len(out[3]) == 2000


def test_atom_entries(spark, tmp_path):
    write(tmp_path / "f.xml", '<?xml version="1.0"?><feed><entry><title>36057</title><link href="http://e/x.zip" type="application/zip"/>'
          '<link href="http://e/y.zip"/></entry><entry><title>36058</title></entry></feed>')
    rows = {(r["title"], r["href"]) for r in readers.atom_entries(spark, str(tmp_path / "f.xml")).collect()}
    assert rows == {("36057", "http://e/x.zip"), ("36057", "http://e/y.zip"), ("36058", None)}


def test_feature_pages(spark, tmp_path):
    page = {"features": [{"attributes": {"ordenanza": "U1", "nome": "n"}, "geometry": {"rings": [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]}},
                         {"attributes": {"ordenanza": None, "nome": None}, "geometry": None}]}
    write(tmp_path / "p0.json", json.dumps(page))
    rows = readers.feature_pages(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["ordinance"], r["rings"] is None, r["page_full"]) for r in rows] == [("U1", False, False), (None, True, False)]


def test_layer_load_skips_an_existing_target(spark, tmp_path):
    raw = spark.createDataFrame([("R1", 1.5, "m"), ("R2", float("nan"), "m")], "REFCAT string, AREA double, MASA string")
    path = str(tmp_path / "blocks")
    readers.load_layer(raw, "blocks", path)
    readers.load_layer(raw.limit(1), "blocks", path)
    assert {(r["refcat"], r["area"]) for r in spark.read.parquet(path).collect()} == {("R1", 1.5), ("R2", None)}
    readers.load_layer(raw.limit(1), "blocks", path, replace=True)
    assert spark.read.parquet(path).count() == 1


def test_street_names_in_latin_1(spark, tmp_path):
    write(tmp_path / "s.csv", "VIA,TTGGSS,DENOMINA,FECHAALTA,FECHABAJA\n12,CL,PEÑA ÁGUILA,1990,0\n", "iso-8859-1")
    assert readers.street_names(spark, str(tmp_path / "s.csv")).first()["denomina"] == "PEÑA ÁGUILA"


def test_wiki_pages(spark, tmp_path):
    write(tmp_path / "art-1.md", '---\narticulo: "1"\ntitulo: "Objeto"\ntags: ["a b", "c"]\n---\n\nCuerpo --- aquí')
    write(tmp_path / "art-2.md", "Sin cabecera")
    rows = {r["articulo"]: r for r in readers.wiki_pages(spark, str(tmp_path)).collect()}
    assert (rows["1"]["titulo"], rows["1"]["tags"], rows["1"]["body"]) == ("Objeto", ["a b", "c"], "Cuerpo --- aquí")
    assert rows[""]["body"] == "Sin cabecera"


def test_article_sink(spark, tmp_path):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "number string, body string")
    sinks.write_articles(a, str(tmp_path / "out"), "norma")
    assert spark.read.json(str(tmp_path / "out" / "articles")).count() == 2
    meta = spark.read.json(str(tmp_path / "out" / "metadata")).first()
    assert (meta["total_articles"], meta["source"]) == (2, "norma")


def test_collection_create_upsert_and_copy(spark, tmp_path):
    path, staging = str(tmp_path / "c"), str(tmp_path / "s")
    schema = "chunk_id string, ordinance_code string, text string, v int, source string"
    old = spark.createDataFrame([("a", "U1", "viejo", 1, "s1"), ("b", "U2", "b", 1, "s1"), ("c", "U1", "c", 1, "s2")], schema)
    sinks.write_collection(old, path, recreate=True)
    assert sinks.create_collection(spark, path, old.schema) == 3
    new = spark.createDataFrame([("a", "U1", "nuevo", 2, "s1"), ("a", "U1", "último", 3, "s1"), ("d", "U9", "d", 1, "s1")], schema)
    for _ in range(2):  # a second run changes nothing
        sinks.upsert_collection(spark, path, staging, new, ["v"])
        rows = {(r["chunk_id"], r["text"], r["source"]) for r in spark.read.parquet(path).collect()}
        assert rows == {("a", "último", "s1"), ("b", "b", "s1"), ("c", "c", "s2"), ("d", "d", "s1")}
    assert sinks.copy_collection(spark, path, str(tmp_path / "copy"))["rows"] == 4
    plan = spark.read.parquet(path).filter("source = 's1' and ordinance_code = 'U1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "EqualTo(ordinance_code,U1)" in plan


def test_zone_sink_rejects(spark, tmp_path):
    z = spark.createDataFrame([("U1-0001", [[1.0]]), (None, [[1.0]]), ("U1-0002", [])], "code string, rings array<array<double>>")
    sinks.write_zones(z, str(tmp_path / "z"), str(tmp_path / "bad"), replace=True)
    assert spark.read.parquet(str(tmp_path / "z")).count() == 1
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["code", "geometry"]


def test_annotations_and_wiki_sink(spark, tmp_path):
    n = spark.createDataFrame([("u", "art-1", "hola"), ("", "art-1", "x"), ("u", None, "x")], "user string, article_ref string, text string")
    sinks.append_annotations(n, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 1
    pages = spark.createDataFrame([("s", "1", "p1"), ("s", "2", "p2")], "source string, number string, page string")
    sinks.write_wiki(pages.limit(1), str(tmp_path / "w"))
    done = spark.read.parquet(str(tmp_path / "w"))
    sinks.write_wiki(pages, str(tmp_path / "w"), done)
    assert sorted(r["wiki_path"] for r in spark.read.parquet(str(tmp_path / "w")).collect()) == ["wiki/s/art-1.md", "wiki/s/art-2.md"]


def _answers(spark, *raws):
    return spark.createDataFrame([(f"r {i}", json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(raws)], "ref string, raw string")


def test_property_answer_shapes(spark):
    unit = {"lcd": "VIVIENDA", "dt": {"lourb": {"loint": {"es": "1", "pt": "02", "pu": "B"}}}, "dfcons": {"stl": "70,5"}}
    base = {"bi": {"idbi": {"cn": "UR"}, "debi": {"sfc": "1.5,0", "cpt": "12,5"}}, "finca": {"dff": {"ss": "99"}}}
    as_list = {"consulta_dnprcResult": {"bico": {**base, "lcons": [unit, unit]}}}
    as_object = {"consulta_dnprcResult": {"bico": {**base, "lcons": {"cons": unit}}}}
    failed = {"consulta_dnprcResult": {"lerr": [{"cod": "1"}]}}
    df = _answers(spark, as_list, as_object, failed, "not json")
    rows = {r["ref"]: r for r in cadastre.property_rows(df).collect()}
    assert set(rows) == {"R0", "R1"} and rows["R0"]["share"] == 12.5 and rows["R0"]["built_area"] is None and rows["R0"]["ground_area"] == 99.0
    units = sorted((r["ref"], r["pos"], r["area"], r["floor"]) for r in cadastre.property_units(df).collect())
    assert units == [("R0", 0, 70.5, "02"), ("R0", 1, 70.5, "02"), ("R1", 0, 70.5, "02")]


def test_nearby_answer(spark):
    ok = {"Consulta_RCCOOR_DistanciaResult": {"coordenadas_distancias": {"coordd": [{"lpcd": [{"pc": {"pc1": "A", "pc2": "B"}, "ldt": "x", "dis": "12.5"}]}]}}}
    r = cadastre.nearby_parcels(_answers(spark, ok, {"Consulta_RCCOOR_DistanciaResult": {"lerr": [{"cod": "9"}]}})).collect()
    assert [(x["parcel_ref"], x["metres"]) for x in r] == [("AB", 12.5)]


def test_image_map_and_decorative(spark):
    m = readers.image_map(spark.createDataFrame([("s", '{"IMAGEN_1":"u1","IMAGEN_2":"u2"}')], "source string, raw string"))
    kept = S.drop_decorative(m, spark.createDataFrame([("s", "IMAGEN_1")], "source string, img_key string"))
    assert [r["url"] for r in kept.collect()] == ["u2"]


def test_link_resolution(spark):
    html = '<a href="a.html">x</a><a href="/b.html">y</a><a href="http://o/c.html">z</a><a href="d.pdf">p</a><a href="a.html">x</a>'
    p = spark.createDataFrame([(1, "http://h/dir/index.html", html)], "page_id int, url string, html string")
    rows = sorted((r["kind"], r["pos"], r["link"]) for r in readers.links(p).collect())
    assert rows == [("html", 0, "http://h/dir/a.html"), ("html", 1, "http://h/b.html"), ("html", 2, "http://o/c.html"), ("pdf", 3, "d.pdf")]
