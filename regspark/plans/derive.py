"""Derived inputs: regulation texts, parcels, zones, units and state built from the given tables.

The given tables hold no regulation text, parcels or zones, so these are computed from their rows; the
derived tables grow with them. Templates in ``SHARED`` are plain SQL that Spark and the SQL oracle both run;
``{table}`` stands for a given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.functions import geometry as G
from regspark.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

# one document per 32 orders: bounded size, number of documents grows with the table
_DOC = "CAST(CAST(floor(o_orderkey / 32) AS BIGINT) AS STRING)"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


SHARED: dict[str, str] = {
    # one article (with its headings) of a markdown rule book per order
    "md_parts": f"""
SELECT 'reg-' || {_DOC} AS source, o_orderkey % 32 AS ord,
  CASE WHEN o_orderkey % 13 = 0 THEN '## CAPÍTULO ' || {_s('o_orderkey % 5 + 1')} || ' Suelo urbano consolidado 12' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 17 = 3 THEN '## Ordenanza U' || {_s('o_orderkey % 9 + 1')} || '.' || {_s('o_orderkey % 3 + 1')} || chr(10) || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 32 IN (28, 30) THEN '## ANEXO ' || CASE WHEN o_orderkey % 32 = 28 THEN 'I' ELSE 'II' END || chr(10) || chr(10)
       || 'Anexo de la orden ' || {_s('o_orderkey')} || chr(10) || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 3 = 0 THEN '## Art. ' WHEN o_orderkey % 3 = 1 THEN '## Articulo ' ELSE '## Artículo ' END
  || {_s('o_orderkey % 29 + 1')} || CASE WHEN o_orderkey % 7 = 2 THEN '.' || {_s('o_orderkey % 4 + 1')} ELSE '' END
  || '. Condiciones ' || lower(o_orderpriority) || chr(10) || chr(10)
  || CASE WHEN o_orderkey % 5 = 1 THEN 'Breve.' || chr(10) || chr(10) ELSE '' END
  || 'La altura máxima será de ' || {_s('o_orderkey % 6 + 2')} || ' plantas y ' || {_s('o_orderkey % 9 + 3')} || ',5 m, según el art. '
  || {_s('o_custkey % 40 + 1')} || CASE WHEN o_orderkey % 2 = 0 THEN '.6' ELSE '' END || ' de esta Normativa.' || chr(10) || chr(10)
  || CASE o_orderstatus
       WHEN 'F' THEN 'Uso  residencial permitido en suelo rústico, ordenanza U' || {_s('o_orderkey % 9 + 1')} || '.A y art. 12 LSG al 10 % de vivienda.' || chr(10) || chr(10)
       WHEN 'O' THEN 'El retranqueo a lindero será de 3 metros conforme al art. ' || {_s('o_custkey % 40 + 1')} || ' y el artículo 46 de la Constitución.' || chr(10) || chr(10)
       ELSE 'Núcleo rural: ocupación del 40 por ciento, art. 18 de la Ley 37/2015 y art. 9 del Real Decreto.' || chr(10) || chr(10) END
  || CASE WHEN o_orderkey % 5 = 0 THEN '| uso | m2 |' || chr(10) || '|---|---|' || chr(10) || '| vivienda | ' || {_s('o_orderkey % 90')} || ' |' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 4 = 1 THEN 'Figura [IMAGEN_' || {_s('o_orderkey % 6 + 1')} || '] del plano' || chr(10) || chr(10) ELSE '' END
  || 'Superficie mínima de ' || {_s('CAST(floor(o_totalprice) AS BIGINT)')} || ' m2 por parcela.' || chr(10) || chr(10) AS part
FROM {{orders}}""",
    # one page of a plain-text rule book per order
    "page_texts": f"""
SELECT 'plan-' || {_DOC} AS doc, o_orderkey % 32 + 1 AS page,
  CASE WHEN o_orderkey % 11 = 0 THEN 'TÍTULO IV. Normas de ' || lower(o_orderpriority) || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 5 = 0 THEN 'CAPÍTULO ' || CASE WHEN o_orderkey % 2 = 0 THEN 'II' ELSE 'VI' END || '. Suelo ' || {_s('o_custkey % 7')} || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 7 = 0 THEN 'Sección ' || {_s('o_orderkey % 4 + 1')} || 'ª. Usos' || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 9 = 0 THEN 'REVISIÓN DEL plan' || chr(10) || 'firma ataD' ELSE '' END
  || 'Art. ' || {_s('o_orderkey % 27 + 1')} || '. Régimen' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) ELSE ' ' END || 'de ' || lower(o_orderpriority) || '.' || chr(10)
  || CASE WHEN o_orderkey % 6 = 4 THEN 'Índice' || chr(10)
       WHEN o_orderkey % 6 = 1 THEN 'Texto sin apartados para la orden ' || {_s('o_orderkey')} || ', que regula el uso del suelo de acuerdo con el art. ' || {_s('o_custkey % 30 + 1')} || ' de las presentes Normas.' || chr(10)
       ELSE '1. Primer apartado con ' || {_s('o_custkey')} || ' condiciones, según el artículo ' || {_s('o_custkey % 50 + 1')} || '.' || {_s('o_custkey % 3')} || ' de la Ley 9/2002.' || chr(10)
         || '2) Segundo apartado que remite al art. 42 del Reglamento.' || chr(10) || 'a) Letra con art. 68 LSG y art. 7 de su reglamento.' || chr(10) END
  || {_s('o_orderkey % 691')} || ' de 691' || chr(10)
  || CASE WHEN o_orderkey % 8 = 0 THEN chr(10) || chr(10) || chr(10) || 'S.E.P.I.A. copia' || chr(10) ELSE '' END AS text
FROM {{orders}}""",
    # image placeholders of every rule book and their files
    "image_map": f"""
SELECT DISTINCT 'reg-' || {_DOC} AS source, 'IMAGEN_' || {_s('o_orderkey % 6 + 1')} AS img_key,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'http://img.example.org/' || {_s('CAST(floor((o_orderkey % 6) / 3) AS BIGINT)')} || '.png' END AS url
FROM {{orders}}""",
    # building units: one per (order, line)
    "units": f"""
SELECT l_orderkey AS building, CAST(l_linenumber AS BIGINT) AS pos,
  'R' || {_s('l_orderkey')} || '-' || {_s('CAST(floor((l_linenumber - 1) / 2) AS BIGINT)')} AS ref,
  CASE WHEN max(l_returnflag) = 'R' THEN 'ELEMENTOS COMUNES' WHEN max(l_partkey) % 3 = 0 THEN 'VIVIENDA' WHEN max(l_partkey) % 3 = 1 THEN 'COMERCIO' ELSE 'ALMACEN' END AS "use",
  sum(l_quantity) AS area,
  CASE WHEN max(l_suppkey) % 3 = 0 THEN '' ELSE {_s('max(l_suppkey) % 3')} END AS stair,
  CASE WHEN max(l_partkey) % 4 = 0 THEN '' ELSE '0' || {_s('max(l_partkey) % 4')} END AS floor,
  CASE WHEN max(l_partkey) % 5 = 0 THEN '' ELSE CASE max(l_partkey) % 5 WHEN 1 THEN 'a ' WHEN 2 THEN 'B' ELSE '00' || {_s('max(l_partkey) % 5')} END END AS door
FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber""",
    # one point per customer
    "points": f"""
SELECT c_custkey AS point_id, -8.79e0 + (c_custkey * 37 % 1800) * 1e-4 AS lon,
  42.13e0 + (c_custkey * 53 % 1700) * 1e-4 + floor(c_custkey / 15000) * 0.17e0 AS lat FROM {{customer}}""",
    # one rectangular zone per supplier, with gaps between them
    "zone_boxes": f"""
SELECT s_suppkey AS zone_id, 'U' || {_s('s_suppkey % 9 + 1')} || '.' || {_s('s_suppkey % 3 + 1')} AS ordinance,
  CASE s_suppkey % 4 WHEN 0 THEN 'SUC' WHEN 1 THEN 'SNR' WHEN 2 THEN 'UNC' ELSE 'SX' END AS land_class,
  -8.79e0 + (s_suppkey % 12) * 15e-3 AS x0, 42.13e0 + CAST(floor(s_suppkey / 12) AS BIGINT) % 3000 * 14e-3 AS y0,
  -8.79e0 + (s_suppkey % 12) * 15e-3 + 13e-3 AS x1, 42.13e0 + CAST(floor(s_suppkey / 12) AS BIGINT) % 3000 * 14e-3 + 12e-3 AS y1,
  s_acctbal FROM {{supplier}}""",
    # one square parcel per part
    "parcel_boxes": f"""
SELECT p_partkey AS parcel_ref, -8.79e0 + (p_partkey * 29 % 1800) * 1e-4 AS x0,
  42.13e0 + (p_partkey * 41 % 1700) * 1e-4 + floor(p_partkey / 15000) * 0.17e0 AS y0,
  -8.79e0 + (p_partkey * 29 % 1800) * 1e-4 + 4e-4 AS x1,
  42.13e0 + (p_partkey * 41 % 1700) * 1e-4 + floor(p_partkey / 15000) * 0.17e0 + 4e-4 AS y1,
  p_name, p_brand, p_size FROM {{part}}""",
    # street addresses of the customers
    "addresses": f"""
SELECT c_custkey AS address_id,
  CASE c_custkey % 8 WHEN 0 THEN 'Rúa do ' WHEN 1 THEN 'Avenida de ' WHEN 2 THEN 'Praza da ' WHEN 3 THEN 'Camiño ' WHEN 4 THEN 'Estrada '
    WHEN 5 THEN 'Paseo de ' WHEN 6 THEN 'calle ' ELSE '' END
  || CASE c_custkey % 3 WHEN 0 THEN 'Príncipe' WHEN 1 THEN 'Urzáiz' ELSE 'Coruña' END
  || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' ' || {_s('c_custkey % 90 + 1')} END
  || CASE WHEN c_custkey % 4 = 0 THEN ', VIGO (PONTEVEDRA)' WHEN c_custkey % 4 = 1 THEN ' Es:1 Pl:02' ELSE '' END AS address FROM {{customer}}""",
    # questions about the parts
    "questions": f"""
SELECT p_partkey AS query_id,
  CASE p_partkey % 6 WHEN 0 THEN '¿Puedo poner un balcón en ' WHEN 1 THEN 'Quiero reformar el ático de ' WHEN 2 THEN 'altura del techo de '
    WHEN 3 THEN 'dame el art. ' || {_s('p_partkey % 182')} || ' sobre ' WHEN 4 THEN 'piscina en el jardín de ' ELSE 'muestra el artigo ' || {_s('p_partkey % 90')} || ' de ' END
  || p_name || ' ' || lower(p_type) AS text,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'U1.1' WHEN 2 THEN 'U1.2' ELSE 'U' || {_s('p_partkey % 9 + 1')} END AS code,
  CASE WHEN p_partkey % 2 = 0 THEN 'gl' ELSE 'es' END AS language FROM {{part}}""",
    # damaged heading and body lines
    "ocr_lines": f"""
SELECT p_partkey AS line_no,
  CASE p_partkey % 6 WHEN 0 THEN '## Articulo' || {_s('p_partkey % 30 + 1')} || '. Verificaciondesucumplimento de ' || p_name
    WHEN 1 THEN '## Articulo ' || {_s('p_partkey % 9 + 1')} || 'o. obrasdeadecuacionfuncionaldeedificios.'
    WHEN 2 THEN '## CondicionesMinimas' || p_type || ' ' || p_name
    WHEN 3 THEN 'Texto deviviendas en ' || p_name || '°. fin enestedecreto'
    WHEN 4 THEN '## articulo ' || {_s('p_partkey % 40 + 1')} || ' CondicionesGeneralesDeVivienda ' || p_name || '.'
    ELSE '## ANEXO II ' || p_name END AS line FROM {{part}}""",
    # building-code documents: coded sections in even documents, numbered and lettered headings in odd ones
    "code_parts": f"""
SELECT 'cte-' || {_s('CAST(floor(p_partkey / 32) AS BIGINT)')} AS source, p_partkey % 32 AS ord,
  CASE WHEN CAST(floor(p_partkey / 32) AS BIGINT) % 2 = 0 THEN '## Sección SI ' || {_s('p_partkey % 20 + 1')} || ' Propagación por ' || p_name
    WHEN p_partkey % 8 = 7 THEN '## Anejo ' || CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b' ELSE 'C' END || ' Tablas de ' || p_name
    ELSE '## ' || {_s('p_partkey % 12 + 1')} || ' Generalidades de ' || p_name END
  || chr(10) || 'Texto ' || p_type || ' ' || p_brand || chr(10) AS part FROM {{part}}""",
    # OCR texts with lettered sections or none
    "ocr_parts": f"""
SELECT 'ocr-' || {_s('CAST(floor(p_partkey / 16) AS BIGINT)')} AS doc, p_partkey % 16 AS ord,
  CASE CAST(floor(p_partkey / 16) AS BIGINT) % 3
    WHEN 0 THEN chr(10) || 'A.' || {_s('p_partkey % 16 + 1')} || '. Condiciones de ' || p_name || chr(10)
    WHEN 1 THEN chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END || '. Exigencias de ' || p_name || chr(10)
    ELSE chr(10) || ' ' || chr(10) END
  || 'Parrafo de ' || p_type || ' con ' || p_brand || ' y otras exigencias de habitabilidad que se repiten en cada unidad.' AS part
FROM {{part}}""",
    # markdown with inline images
    "image_parts": f"""
SELECT 'img-' || {_DOC} AS source, o_orderkey % 32 AS ord,
  'texto  ' || {_s('o_orderkey')} || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' ![Image](data:image/' || CASE WHEN o_orderkey % 2 = 0 THEN 'png' ELSE 'jpeg' END
  || ';base64,' || CASE o_custkey % 4 WHEN 0 THEN 'aG9sYQ==' WHEN 1 THEN 'bXVuZG8=' WHEN 2 THEN 'cGxhbm8=' ELSE 'em9uYQ==' END || ')' END || ' fin ' || chr(10) AS part
FROM {{orders}}""",
    # state transitions: an event moves the chunk of its user
    "state_log": f"""
SELECT 'c' || {_s('user_id')} AS chunk_id, ts, event_id AS seq, event_type,
  CASE WHEN event_type IN ('purchase', 'view') THEN true ELSE false END AS indexed, 'resumen ' || {_s('event_id')} AS summary FROM {{events}}""",
    # chunks the state refers to: one per customer, more than have a state
    "state_chunks": f"""
SELECT 'c' || {_s('c_custkey')} AS chunk_id, lower(c_mktsegment) AS source, c_name AS text, '' AS summary FROM {{customer}}""",
    # link graph between article numbers
    "edges": "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM {lineitem}",
    # chats with the active parcel
    "chat": f"""
SELECT conv_id, turn, role, text, 'P' || {_s('(conv_id * 31 + CAST(floor(turn / 3) AS BIGINT)) % 7')} AS rc FROM {{conversations}}""",
}

# rows that regex or geometry work follows; a table in one file would be one task
PER_ROW_WORK = {"md_parts", "page_texts", "addresses", "questions", "ocr_lines", "parcel_boxes"}

# dictionary used by the registered query-expansion queries; deployments pass their own
DICTIONARY = [
    ("balcón", ["vuelo", "cuerpo volado", "voladizo"]),
    ("ático", ["última planta", "planta ático"]),
    ("reformar", ["obras de remodelación", "rehabilitación"]),
    ("techo", ["cubierta", "altura libre"]),
    ("altura del techo", ["altura libre", "altura entre forjados"]),
    ("jardín", ["espacio libre privado"]),
    ("piscina", ["instalación deportiva", "espacio libre privado"]),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of ``SHARED`` as a DataFrame."""
    sql = SHARED[name].replace('"use"', "use")
    wide = spread if name in PER_ROW_WORK else (lambda df: df)
    used = {t: wide(table(spark, sf, t)) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def shared_sql(name: str) -> str:
    """The same table as SQL for the oracle."""
    return SHARED[name].format(**{t: t for t in TABLES})


def with_shared(*names: str) -> str:
    """``WITH`` clause that defines shared tables for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({shared_sql(n)})" for n in names)


def _joined(df: DataFrame, key: str, order: str, text: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "").alias(out))


def markdown_docs(spark: SparkSession, sf: str) -> DataFrame:
    """source, md: rule books in markdown."""
    return _joined(shared(spark, sf, "md_parts"), "source", "ord", "part", "md")


def plain_docs(spark: SparkSession, sf: str) -> DataFrame:
    """doc, text: rule books in plain text."""
    return _joined(shared(spark, sf, "page_texts"), "doc", "page", "text", "text")


DOC_SQL = {
    "md_docs": "SELECT source, string_agg(part, '' ORDER BY ord) AS md FROM md_parts GROUP BY source",
    "plain_docs": "SELECT doc, string_agg(text, '' ORDER BY page) AS text FROM page_texts GROUP BY doc",
}


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk collection with three vectors: every embedding with the payload of its document."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    v = F.col("embedding").cast("array<double>")
    n = F.col("label")
    return e.join(d.select("doc_id", "text", "source", "lang"), e.vec_id == d.doc_id, "left").select(
        F.substring(F.md5(F.concat(F.lit("v_"), F.col("vec_id").cast("string"))), 1, 12).alias("chunk_id"), "vec_id",
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"),
        F.concat(F.lit("U"), (n % 9 + 1).cast("string")).alias("ordinance_code"),
        (F.col("vec_id") % 182 + 1).cast("string").alias("article_no"),
        F.concat(F.lit("Cabecera | Art. "), (F.col("vec_id") % 182 + 1).cast("string")).alias("header"),
        F.when(n % 3 == 0, "urbano").when(n % 3 == 1, "rustico").otherwise("").alias("scope"),
        (n % 2 == 0).alias("defines_height"), (n == 4).alias("defines_occupation"), (n == 5).alias("defines_buildability"),
        F.lit(False).alias("defines_setbacks"),
        v.alias("v_text"), F.transform(v, lambda x, i: x * (F.lit(1.0) + (i % 5) * F.lit(0.1))).alias("v_summary"),
        F.zip_with(v, F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1)), lambda a, b: (a + b) * F.lit(0.5)).alias("v_questions"))


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per benchmark item; its vector is the embedding with the same number. An item without one has no hits."""
    b, e = table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    return b.join(e, b.item_id == e.vec_id, "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").cast("array<double>").alias("vector"),
        F.when(F.col("item_id") % 4 == 0, "").when(F.col("item_id") % 4 == 1, "U99")
        .otherwise(F.concat(F.lit("U"), (F.coalesce("label", F.lit(0)) % 9 + 1).cast("string"))).alias("ordinance_code"))


VECTOR_SQL = """
vchunks AS (SELECT substr(md5('v_' || CAST(vec_id AS VARCHAR)), 1, 12) AS chunk_id, vec_id, coalesce(d.text, '') AS text,
  coalesce(d.source, 'none') AS source, 'U' || CAST(label % 9 + 1 AS VARCHAR) AS ordinance_code, CAST(vec_id % 182 + 1 AS VARCHAR) AS article_no,
  'Cabecera | Art. ' || CAST(vec_id % 182 + 1 AS VARCHAR) AS header,
  CASE label % 3 WHEN 0 THEN 'urbano' WHEN 1 THEN 'rustico' ELSE '' END AS scope,
  label % 2 = 0 AS defines_height, label = 4 AS defines_occupation, label = 5 AS defines_buildability, false AS defines_setbacks,
  CAST(embedding AS DOUBLE[]) AS v_text,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * (1e0 + ((i - 1) % 5) * 1e-1)) AS v_summary,
  list_transform(list_zip(CAST(embedding AS DOUBLE[]), list_concat(CAST(embedding AS DOUBLE[])[2:], CAST(embedding AS DOUBLE[])[1:1])),
    lambda p: (p[1] + p[2]) * 5e-1) AS v_questions
  FROM embeddings LEFT JOIN documents d ON vec_id = doc_id),
vqueries AS (SELECT item_id AS query_id, b.text AS query, CAST(embedding AS DOUBLE[]) AS vector,
  CASE WHEN item_id % 4 = 0 THEN '' WHEN item_id % 4 = 1 THEN 'U99' ELSE 'U' || CAST(coalesce(label, 0) % 9 + 1 AS VARCHAR) END AS ordinance_code
  FROM benchmark b LEFT JOIN embeddings ON item_id = vec_id),
sims AS (SELECT query_id, view, chunk_id, round(list_cosine_similarity(vector, v), 9) AS score, q.ordinance_code AS qcode,
  c.ordinance_code AS ccode, c.source, c.scope FROM vqueries q, (
  SELECT chunk_id, ordinance_code, source, scope, 'text' AS view, v_text AS v FROM vchunks
  UNION ALL SELECT chunk_id, ordinance_code, source, scope, 'summary', v_summary FROM vchunks
  UNION ALL SELECT chunk_id, ordinance_code, source, scope, 'questions', v_questions FROM vchunks) c WHERE vector IS NOT NULL)"""


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """zone_id, ordinance, land_class and rings."""
    z = shared(spark, sf, "zone_boxes")
    return z.withColumn("rings", G.box(z.x0, z.y0, z.x1, z.y1))


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    """parcel_ref and rings."""
    p = shared(spark, sf, "parcel_boxes")
    return p.withColumn("rings", G.box(p.x0, p.y0, p.x1, p.y1))
