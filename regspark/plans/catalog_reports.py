"""Report, quality and service-answer queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.functions import text as C
from regspark.operators import partials as PS
from regspark.operators import quality as Q
from regspark.operators import segment as S
from regspark.operators import streets as ST
from regspark.operators.parcels import street_candidates
from regspark.plans import derive as D
from regspark.plans.catalog import ORACLES, lit, register
from regspark.plans.catalog_segment import ARTICLES, CHUNKS, ITEMS, REAL, _arts, _chunks, _real
from regspark.plans.catalog_text import street_sql, strip
from regspark.session import ensure_checkpoint_dir
from regspark.sources import cadastre, readers


@register("a01_extraction_report", f"""{REAL} SELECT count(*) AS articles, sum(chars)::BIGINT AS chars, round(avg(chars), 2) AS mean_chars,
first(number ORDER BY chars DESC, number) AS longest, first(number ORDER BY chars, number) AS shortest FROM real""")
def _(spark, sf):
    return Q.extraction_report(_real(spark, sf))


@register("a01_extraction_report_per_document", f"""{REAL} SELECT doc, count(*) AS articles, sum(chars)::BIGINT AS chars, round(avg(chars), 2) AS mean_chars,
first(number ORDER BY chars DESC, number) AS longest, first(number ORDER BY chars, number) AS shortest FROM real GROUP BY doc""")
def _(spark, sf):
    return Q.extraction_report(_real(spark, sf), ["doc"])


@register("a02_duplicate_numbers", f"""{ARTICLES} SELECT doc, number, pos, heading, copies FROM (SELECT *, count(*) OVER (PARTITION BY doc, number) AS copies FROM arts) WHERE copies > 1""")
def _(spark, sf):
    return Q.duplicate_numbers(_arts(spark, sf))


@register("a02_number_profile", f"""{ARTICLES} SELECT doc, min(TRY_CAST(number AS INT)) AS min_number, max(TRY_CAST(number AS INT)) AS max_number, count(*) FILTER (TRY_CAST(number AS INT) IS NULL) AS not_numeric FROM arts GROUP BY doc""")
def _(spark, sf):
    return Q.number_profile(_arts(spark, sf))


@register("a03_j14_x02_missing_numbers", f"""{ARTICLES} SELECT n AS number FROM range(1, 183) t(n) WHERE n NOT IN (SELECT CAST(number AS BIGINT) FROM arts)""")
def _(spark, sf):
    return Q.missing_numbers(_arts(spark, sf), 182)


@register("a03_missing_numbers_per_document", f"""{ARTICLES} SELECT doc, n AS number FROM (SELECT DISTINCT doc FROM arts) d, range(1, 183) t(n) WHERE NOT EXISTS (SELECT 1 FROM arts a WHERE a.doc = d.doc AND TRY_CAST(a.number AS BIGINT) = n)""")
def _(spark, sf):
    return Q.missing_per_document(_arts(spark, sf), 182)


@register("a04_paragraph_report_per_document", f"""{REAL}, {ITEMS}, k AS (SELECT doc, len(ps) >= 2 AS num, CASE WHEN len(ps) >= 2 THEN len(its) ELSE 0 END AS n FROM items)
SELECT doc, count(*) AS articles, count(*) FILTER (num) AS numbered, count(*) FILTER (NOT num) AS simple, round(count(*) FILTER (num) * 1e2 / count(*), 1) AS numbered_share,
sum(n)::BIGINT AS paragraphs, round(sum(n)::DOUBLE / nullif(count(*) FILTER (num), 0), 2) AS mean_paragraphs FROM k GROUP BY doc""")
def _(spark, sf):
    s = _real(spark, sf).select("doc", S.numbered_paragraphs("body").alias("s"))
    return Q.paragraph_report(s.select("doc", "s.kind", F.size("s.paragraphs").alias("n_paragraphs")), ["doc"])


@register("a04_paragraph_report", f"""{REAL}, {ITEMS}, k AS (SELECT len(ps) >= 2 AS num, CASE WHEN len(ps) >= 2 THEN len(its) ELSE 0 END AS n FROM items)
SELECT count(*) AS articles, count(*) FILTER (num) AS numbered, count(*) FILTER (NOT num) AS simple, round(count(*) FILTER (num) * 1e2 / count(*), 1) AS numbered_share,
sum(n)::BIGINT AS paragraphs, round(sum(n)::DOUBLE / count(*) FILTER (num), 2) AS mean_paragraphs FROM k""")
def _(spark, sf):
    s = _real(spark, sf).select(S.numbered_paragraphs("body").alias("s"))
    return Q.paragraph_report(s.select("s.kind", F.size("s.paragraphs").alias("n_paragraphs")))


@register("a04_most_paragraphs", f"""{REAL}, {ITEMS} SELECT doc, number, CASE WHEN len(ps) >= 2 THEN len(its) ELSE 0 END AS n FROM items ORDER BY n DESC, doc, number LIMIT 10""")
def _(spark, sf):
    s = _real(spark, sf).select("doc", "number", F.size(S.numbered_paragraphs("body")["paragraphs"]).alias("n"))
    return s.orderBy(F.desc("n"), "doc", "number").limit(10)


@register("a05_chunk_report", f"""{CHUNKS} SELECT count(*) AS chunks, count(*) FILTER (ordinance_code <> '') AS with_ordinance, count(*) FILTER (has_tables) AS with_tables, count(*) FILTER (raw_images <> '') AS with_images FROM chunks""")
def _(spark, sf):
    return Q.chunk_report(_chunks(spark, sf))


@register("a06_chunks_per_source", "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS chunks FROM documents GROUP BY ROLLUP (source)")
def _(spark, sf):
    return Q.chunks_per_source(D.table(spark, sf, "documents"))


@register("a07_question_coverage", """WITH q AS (SELECT list_filter(string_split(text, chr(10)), lambda x: contains(x, '?')) AS qs FROM conversations)
SELECT count(*) FILTER (len(qs) > 0) AS with_questions, count(*) FILTER (len(qs) = 0) AS without_questions FROM q""")
def _(spark, sf):
    c = D.table(spark, sf, "conversations")
    return Q.question_coverage(c.select(F.filter(F.split("text", "\n"), lambda x: x.contains("?")).alias("questions")))


PARAMS = ["CASE WHEN zone_id % 3 = 0 THEN NULL ELSE s_acctbal END AS buildability", "CASE WHEN zone_id % 5 < 2 THEN NULL ELSE zone_id END AS max_height",
          "nullif(land_class, 'SX') AS land_class"]


@register("a08_null_completeness", f"""{D.with_shared('zone_boxes')}, p AS (SELECT {', '.join(PARAMS)} FROM zone_boxes) SELECT count(*) - count(buildability) AS no_buildability,
count(*) - count(max_height) AS no_max_height, count(*) - count(land_class) AS no_land_class, count(*) AS "rows" FROM p""")
def _(spark, sf):
    return Q.null_counts(D.shared(spark, sf, "zone_boxes").selectExpr(*PARAMS), ["buildability", "max_height", "land_class"])


@register("a09_url_frequency", f"{D.with_shared('image_map')} SELECT url, count(*) AS n FROM image_map GROUP BY url")
def _(spark, sf):
    return Q.value_frequency(D.shared(spark, sf, "image_map"), "url")


def _batches(spark, sf, rows, add, name):
    """Three ingest batches of a table, the second of them twice, in a folder of partial states."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for k in (0, 1, 1, 2):
        add(rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == k), folder, f"{k:04d}")
    return folder


@register("a09_merged_frequency", ORACLES["a09_url_frequency"])
def _(spark, sf):
    folder = _batches(spark, sf, D.shared(spark, sf, "image_map"), lambda d, f, b: PS.add_counts(d, ["url"], f, b), "urls")
    return PS.merged_counts(spark, folder, ["url"])


@register("a15_merged_progress", """SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (lang = 'en') AS english FROM documents GROUP BY source""")
def _(spark, sf):
    rows = D.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    folder = _batches(spark, sf, rows, lambda d, f, b: PS.add_counts(d, ["source"], f, b, chars=F.col("n_chars"), english=F.when(F.col("lang") == "en", 1).otherwise(0)), "progress")
    return PS.merged_counts(spark, folder, ["source"])


@register("a13_most_frequent_value", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 1")
def _(spark, sf):
    return Q.most_frequent(D.table(spark, sf, "part"), "p_type")


@register("a14_long_articles", "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 4000")
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"))
    return Q.long_articles(d)


@register("a16_image_totals", f"""{D.with_shared('image_parts')}, d AS (SELECT source, unnest(regexp_extract_all(part, {lit(X.INLINE_IMAGE_PARTS)}, 2)) AS b FROM image_parts)
SELECT source, count(*) AS images, count(DISTINCT b) AS unique_images FROM d GROUP BY source""")
def _(spark, sf):
    docs = D._joined(D.shared(spark, sf, "image_parts"), "source", "ord", "part", "md")
    return Q.image_totals(readers.deduplicated_images(docs))


@register("a16_merged_image_totals", ORACLES["a16_image_totals"])
def _(spark, sf):
    docs = D._joined(D.shared(spark, sf, "image_parts"), "source", "ord", "part", "md")
    rows = readers.deduplicated_images(docs).select("source", "hash")
    folder = _batches(spark, sf, rows, lambda d, f, b: PS.add_distinct(d, "source", "hash", f, b), "images")
    return PS.merged_distinct(spark, folder, "source", "hash").select("source", F.col("n").alias("images"), F.col("different").alias("unique_images"))


FIRST_WORDS = "list_distinct(list_filter(string_split(lower(substr(text, 1, 60)), ' '), lambda x: x <> ''))"


@register("c17_j15_shared_words", f"""WITH w AS (SELECT doc_id, {FIRST_WORDS} AS ws FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS id_a, b.doc_id AS id_b, len(list_intersect(a.ws, b.ws)) AS common FROM w a JOIN w b ON b.doc_id % 10 = 0 AND len(list_intersect(a.ws, b.ws)) >= 2""")
def _(spark, sf):
    """Pairs that share two of their first words; every tenth document stands for a street."""
    ws = F.array_distinct(F.filter(F.split(F.lower(F.substring("text", 1, 60)), " "), lambda x: x != ""))
    rows = D.table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), ws.alias("tokens"))
    return ST.sharing(rows, rows.filter("id % 10 = 0")).withColumn("common", F.col("common").cast("long"))


@register("s11_layer_profile", f"""{D.with_shared('zone_boxes')} SELECT count(*) AS "rows", string_agg(DISTINCT CASE WHEN zone_id % 4 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END, ',' ORDER BY CASE WHEN zone_id % 4 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END) AS geometry_types FROM zone_boxes""")
def _(spark, sf):
    z = D.shared(spark, sf, "zone_boxes").select(F.when(F.col("zone_id") % 4 == 0, "Polygon").otherwise("MultiPolygon").alias("kind"))
    return Q.layer_profile(z, "kind")


# ------------------------------------------------------------------ stored service answers

# answers are written from the customers and parts; the oracle reads the columns they were written from
PROPERTY = """CASE WHEN c_custkey % 11 = 10 THEN '{{"consulta_dnprcResult":{{"lerr":[{{"cod":"5"}}]}}}}' ELSE
'{{"consulta_dnprcResult":{{"bico":{{"bi":{{"idbi":{{"cn":"' || CASE WHEN c_custkey % 4 = 0 THEN 'RU' ELSE 'UR' END || '"}},"ldt":"' || c_name || '","dt":{{"np":"PONTEVEDRA","nm":"VIGO","locs":{{"lous":{{"lourb":{{"dp":"36' || c_custkey || '","dir":{{"tv":"CL","nv":"' || c_mktsegment || '","pnp":"' || c_nationkey || '"}}}}}}}}}},"debi":{{"luso":"Residencial","sfc":"' || c_nationkey || ',5","ant":"19' || c_nationkey || '","cpt":"x"}}}},"finca":{{"ltp":"Parcela","dff":{{' || CASE WHEN c_custkey % 2 = 0 THEN '"ss":"' || c_custkey || '"' ELSE '"ssf":{{"ss":"' || c_custkey || ',25"}}' END || '}}}},"lcons":' ||
CASE WHEN c_custkey % 3 = 0 THEN '[' ELSE '{{"cons":[' END || '{{"lcd":"VIVIENDA","dt":{{"lourb":{{"loint":{{"es":"1","pt":"0' || c_nationkey || '","pu":"A"}}}}}},"dfcons":{{"stl":"' || c_nationkey || ',75"}}}},{{"lcd":"ALMACEN","dfcons":{{"stl":"n"}}}}' ||
CASE WHEN c_custkey % 3 = 0 THEN ']' ELSE ']}}' END || '}}}}}}' END"""


def answers(spark, sf, table: str, key: str, expr: str):
    return spark.sql(f"SELECT {key}, {expr} AS raw FROM {{t}}", t=D.table(spark, sf, table))


@register("s14_property_rows", """SELECT 'R' || c_custkey AS ref, CASE WHEN c_custkey % 4 = 0 THEN 'Rústico' ELSE 'Urbano' END AS land_kind, c_name AS address, '36' || c_custkey AS postcode, c_mktsegment AS street_name, CAST(c_nationkey AS VARCHAR) AS house_number,
c_nationkey + 5e-1 AS built_area, '19' || c_nationkey AS built_year, true AS no_share, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE ELSE c_custkey + 25e-2 END AS ground_area FROM customer WHERE c_custkey % 11 <> 10""")
def _(spark, sf):
    rows = cadastre.property_rows(answers(spark, sf, "customer", "'R' || c_custkey AS ref", PROPERTY))
    return rows.select("ref", "land_kind", "address", "postcode", "street_name", "house_number", "built_area", "built_year",
                       F.col("share").isNull().alias("no_share"), "ground_area")


@register("s15_property_units", """SELECT 'R' || c_custkey AS ref, p AS pos, CASE p WHEN 0 THEN 'VIVIENDA' ELSE 'ALMACEN' END AS "use", CASE p WHEN 0 THEN c_nationkey + 75e-2 ELSE -1 END AS area,
CASE p WHEN 0 THEN '0' || c_nationkey ELSE '' END AS floor FROM customer, (VALUES (0), (1)) v(p) WHERE c_custkey % 11 <> 10""")
def _(spark, sf):
    u = cadastre.property_units(answers(spark, sf, "customer", "'R' || c_custkey AS ref", PROPERTY))
    return u.select("ref", "pos", "use", F.coalesce("area", F.lit(-1.0)).alias("area"), F.coalesce("floor", F.lit("")).alias("floor"))


COORD = """CASE WHEN c_custkey % 5 = 4 THEN '{{"Consulta_RCCOORResult":{{"lerr":[{{"cod":"16"}}]}}}}' ELSE '{{"Consulta_RCCOORResult":{{"coordenadas":{{"coord":' || CASE WHEN c_custkey % 2 = 0 THEN '[' ELSE '' END
|| '{{"pc":{{"pc1":"' || c_custkey || 'A","pc2":"' || c_nationkey || 'B"}},"ldt":"' || c_name || '"}}' || CASE WHEN c_custkey % 2 = 0 THEN ']' ELSE '' END || '}}}}}}' END"""


@register("s16_coordinate_parcels", "SELECT c_custkey AS point_id, c_custkey || 'A' || c_nationkey || 'B' AS parcel_ref, c_name AS address FROM customer WHERE c_custkey % 5 <> 4")
def _(spark, sf):
    return cadastre.coordinate_parcels(answers(spark, sf, "customer", "c_custkey AS point_id", COORD))


RC = """'{{"rc":{{"pc1":"' || c_custkey || '","pc2":"P","car":"00' || c_nationkey || '","cc1":"X","cc2":"Y"}}}}'"""
ADDRESS = f"""CASE WHEN c_custkey % 3 = 0 THEN '{{{{"consulta_dnplocResult":{{{{"lrcdnp":{{{{"rcdnp":[' || {RC} || ',' || replace({RC}, '"P"', '"Q"') || ']}}}}}}}}}}}}'
WHEN c_custkey % 3 = 1 THEN '{{{{"consulta_dnplocResult":{{{{"lrcdnp":{{{{"rcdnp":' || {RC} || '}}}}}}}}}}}}' ELSE '{{{{"consulta_dnplocResult":{{{{"bico":{{{{"bi":{{{{"idbi":' || {RC} || '}}}}}}}}}}}}}}}}' END"""


@register("s17_address_references", """SELECT c_custkey AS address_id, 0 AS pos, c_custkey || 'P00' || c_nationkey || 'XY' AS ref FROM customer
UNION ALL SELECT c_custkey, 1, c_custkey || 'Q00' || c_nationkey || 'XY' FROM customer WHERE c_custkey % 3 = 0""")
def _(spark, sf):
    return cadastre.address_references(answers(spark, sf, "customer", "c_custkey AS address_id", ADDRESS))


STREETS = """CASE WHEN c_custkey % 6 = 5 THEN '<consulta xmlns="http://e.example/"><lerr><err><cod>9</cod></err></lerr></consulta>' ELSE '<consulta xmlns="http://e.example/"><callejero><calle><loine><cp>36</cp></loine><dir><cv>' || c_custkey || '</cv><tv>CL</tv><nv>' || c_mktsegment || '</nv></dir></calle>'
|| '<calle><dir><cv>' || c_nationkey || '</cv><tv>AV</tv><nv>' || c_name || '</nv></dir></calle></callejero></consulta>' END"""


@register("s18_street_rows", """SELECT c_custkey AS search_id, 0 AS pos, 'CL' AS street_type, c_mktsegment AS street_name, CAST(c_custkey AS VARCHAR) AS street_code FROM customer WHERE c_custkey % 6 <> 5
UNION ALL SELECT c_custkey, 1, 'AV', c_name, CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 6 <> 5""")
def _(spark, sf):
    return cadastre.street_rows(answers(spark, sf, "customer", "c_custkey AS search_id", STREETS))


NAMES = "CASE {k} % 3 WHEN 0 THEN 'PRINCIPE' WHEN 1 THEN 'URZAIZ' ELSE 'CORUNA' END"
NO_NUMBER = r"regexp_replace(address, '\s+\d+', '', 'g')"
TYPES = "CASE {k} % 4 WHEN 0 THEN 'AV' WHEN 1 THEN 'CL' WHEN 2 THEN 'CR' ELSE 'PZ' END"


@register("f07_j15_street_candidates", f"""{D.with_shared('addresses')}, st AS (SELECT n_nationkey AS via, CASE WHEN n_nationkey < 20 THEN {TYPES.format(k='n_nationkey')} ELSE 'XX' END AS street_type, {NAMES.format(k='n_nationkey')} AS street_name FROM nation),
ad AS (SELECT address_id, {strip(NO_NUMBER)} AS address FROM addresses), a AS (SELECT address_id, {street_sql('types')} AS types, strip_accents({street_sql('name')}) AS street_name FROM ad),
t AS (SELECT address_id, street_name, unnest(range(len(string_split(types, ',')))) AS priority, unnest(string_split(types, ',')) AS street_type FROM a WHERE street_name <> '')
SELECT address_id, via, street_type, street_name FROM t JOIN st USING (street_type, street_name) QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY priority, via) = 1""")
def _(spark, sf):
    st = spark.sql("SELECT n_nationkey AS via, CASE WHEN n_nationkey < 20 THEN " + TYPES.format(k="n_nationkey") + " ELSE 'XX' END AS street_type, " + NAMES.format(k="n_nationkey")
                   + " AS street_name FROM {t}", t=D.table(spark, sf, "nation"))
    # the number stays part of a captured name, so it is taken off before the lookup
    a = D.shared(spark, sf, "addresses").select("address_id", C.strip(F.regexp_replace("address", r"\s+\d+", "")).alias("address"))
    return street_candidates(a, st)
