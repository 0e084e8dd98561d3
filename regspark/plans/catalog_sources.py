"""Source parsers on text derived from the tables, sinks by what they leave, and the two-phase run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from regspark.plans import derive as D
from regspark.plans.catalog import register
from regspark.providers import HashingEmbedding
from regspark.session import ensure_checkpoint_dir
from regspark.sources import readers, sinks
from regspark.streaming import jobs


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"


@register("s02_article_rows", """SELECT c_custkey, k AS numero, 'Articulo ' || k AS titulo, 'texto ' || c_name AS contenido, 'simple' AS kind, length(c_name) AS longitud_caracteres
FROM customer, (SELECT unnest(['1', '2b']) AS k)""")
def _(spark, sf):
    article = lambda k: F.concat(F.lit(f'{{"numero":"{k}","titulo":"Articulo {k}","contenido":"texto '), "c_name", F.lit('","contenido_estructurado":{"tipo":"simple"},"longitud_caracteres":'), F.length("c_name").cast("string"), F.lit("}"))
    raw = F.concat(F.lit('{"metadata":{"total_articulos":2},"articulos":['), article("1"), F.lit(","), article("2b"), F.lit("]}"))
    rows = readers.article_rows(D.table(spark, sf, "customer").select("c_custkey", raw.alias("raw")))
    return rows.select("c_custkey", "numero", "titulo", "contenido", F.col("contenido_estructurado.tipo").alias("kind"), "longitud_caracteres")


@register("s07_atom_entries", """SELECT p_partkey, p_name AS title, 'http://h/' || p_partkey || '.' || k AS href, 'application/' || k AS type FROM part, (SELECT unnest(['zip', 'xml']) AS k)""")
def _(spark, sf):
    link = lambda k: F.concat(F.lit('<link rel="e" href="http://h/'), F.col("p_partkey").cast("string"), F.lit(f'.{k}" type="application/{k}"/>'))
    raw = F.concat(F.lit("<entry><title>"), "p_name", F.lit("</title>"), link("zip"), link("xml"), F.lit("</entry>"))
    return readers.entry_rows(D.table(spark, sf, "part").select("p_partkey", raw.alias("raw")))


@register("s08_feature_rows", """SELECT 'p' || s_suppkey AS file, false AS page_full, i AS idx, 'U' || i AS ordinance, s_name AS name, CAST(s_nationkey AS DOUBLE) AS x, CAST(i AS DOUBLE) AS y FROM supplier, (SELECT unnest([0, 1]) AS i)""")
def _(spark, sf):
    feature = lambda i: F.concat(F.lit(f'{{"attributes":{{"ordenanza":"U{i}","nome":"'), "s_name", F.lit('"},"geometry":{"rings":[[['), F.col("s_nationkey").cast("string"), F.lit(f",{i}]]]}}}}"))
    raw = F.concat(F.lit('{"features":['), feature(0), F.lit(","), feature(1), F.lit("]}"))
    rows = readers.feature_rows(D.table(spark, sf, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("file"), raw.alias("raw")))
    return rows.select("file", "page_full", "idx", "ordinance", "name", F.col("rings")[0][0][0].alias("x"), F.col("rings")[0][0][1].alias("y"))


@register("s09_layer_columns", "SELECT p_partkey AS refcat, p_brand AS masa, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS area FROM part")
def _(spark, sf):
    size = F.when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double"))
    return readers.layer(D.table(spark, sf, "part").select(F.col("p_partkey").alias("REFCAT"), F.col("p_brand").alias("MASA"), size.alias("AREA"), F.col("p_name").alias("OTHER")), "blocks")


@register("s10_street_rows", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS via, 'CL' AS ttggss, 'PEÑA ' || c_name AS denomina, '1990' AS fechaalta, '0' AS fechabaja FROM customer")
def _(spark, sf):
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(",CL,PEÑA "), "c_name", F.lit(",1990,0"))
    return readers.street_rows(D.table(spark, sf, "customer").select("c_custkey", F.encode(line, "ISO-8859-1").alias("raw")))


@register("s12_wiki_fields", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS articulo, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS titulo,
CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ',b' END AS tags, md5(CASE WHEN doc_id % 3 = 0 THEN 'sin cabecera ' || n_chars ELSE 'cuerpo --- ' || n_chars END) AS body_md5 FROM documents""")
def _(spark, sf):
    n = F.col("n_chars").cast("string")
    page = F.concat(F.lit('---\narticulo: "'), F.col("doc_id").cast("string"), F.lit('"\ntitulo: "'), "source", F.lit('"\ntags: ["'), "lang", F.lit('", "b"]\n---\n\ncuerpo --- '), n)
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sin cabecera "), n)).otherwise(page)
    rows = readers.front_matter(D.table(spark, sf, "documents").select("doc_id", content.alias("content")))
    return rows.select("doc_id", "articulo", "titulo", F.array_join("tags", ",").alias("tags"), F.md5("body").alias("body_md5"))


@register("k01_article_files", "SELECT doc_id, md5(text) AS body_md5, (SELECT count(*) FROM documents) AS total_articles, 'norma' AS source FROM documents")
def _(spark, sf):
    out = _scratch(spark)
    sinks.write_articles(D.table(spark, sf, "documents").select("doc_id", "text"), out, "norma")
    meta = spark.read.json(f"{out}/metadata").first()
    return spark.read.schema("doc_id long, text string").json(f"{out}/articles").select(
        "doc_id", F.md5("text").alias("body_md5"), F.lit(meta["total_articles"]).alias("total_articles"), F.lit(meta["source"]).alias("source"))


@register("k02_k03_collection", "SELECT doc_id, source, lang AS ordinance_code, md5(text) AS text_md5 FROM documents")
def _(spark, sf):
    out = _scratch(spark)
    chunks = D.table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("ordinance_code"), "text")
    sinks.create_collection(spark, out, chunks.schema)
    sinks.write_collection(chunks, out, recreate=True)
    return spark.read.schema(chunks.schema).parquet(out).select("doc_id", "source", "ordinance_code", F.md5("text").alias("text_md5"))


class _FixedQuestion:
    """A text provider with one answer for every text."""

    def complete(self, prompt: str) -> str:
        return "1. ¿Qué regula este artículo de la norma?"


@register("m01_m02_two_phase_state", "SELECT DISTINCT 'e' || user_id AS chunk_id, true AS indexed, '¿Qué regula este artículo de la norma?' AS question FROM events")
def _(spark, sf):
    """Enrich and index every user of the event table; the state after both phases."""
    name = F.concat(F.lit("e"), F.col("user_id").cast("string"))
    users = D.table(spark, sf, "events").select("user_id").distinct().select(
        name.alias("chunk_id"), F.concat(F.lit("altura de "), name).alias("text"), F.concat(F.lit("cab\n\n"), name).alias("text_with_header"),
        F.lit("cab").alias("header"), F.lit("U1").alias("ordinance_code"))
    index, state = _scratch(spark), _scratch(spark)
    jobs.two_phase_run(users, _FixedQuestion(), HashingEmbedding(8), index, state)
    done = jobs.read_state(spark, state).join(jobs.read_index(spark, index).select("chunk_id"), "chunk_id")
    return done.select("chunk_id", "indexed", F.col("questions")[0].alias("question"))
