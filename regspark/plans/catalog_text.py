"""Text normalisation and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions import features as FE
from regspark.functions import fixed as X
from regspark.functions import text as C
from regspark.operators import terms
from regspark.plans import derive as D
from regspark.plans.catalog import ORACLES, lit, register
from regspark.sources import readers as R

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def strip(e: str) -> str:
    return STRIP.format(e)


def chain(expr: str, steps: list[tuple[str, str]], options: str = "'g'") -> str:
    for pattern, repl in steps:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {repl}, {options})"
    return expr


ELEMENTS = [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "''") for t in X.REMOVED_TAGS] + [(r"(?s)<!--.*?-->", "''")]
FOOT = [(("(?s)" if dot else "") + p, "''") for p, dot in X.FOOTERS]


def repairs(e: str) -> str:
    for wrong, right in X.OCR_REPAIRS:
        e = f"replace({e}, {lit(wrong)}, {lit(right)})"
    return e


@register("c01_html_element_removal", f"SELECT page_id, {chain('html', ELEMENTS)} AS html FROM pages")
def _(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", C.remove_elements("html").alias("html"))


@register("c02_page_footers", f"{D.with_shared('page_texts')} SELECT doc, page, {chain('text', FOOT)} AS text FROM page_texts")
def _(spark, sf):
    return D.shared(spark, sf, "page_texts").select("doc", "page", C.remove_footers("text").alias("text"))


@register("c03_collapse_newlines", rf"""{D.with_shared('page_texts')}
SELECT doc, page, regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g') AS text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one_line FROM page_texts""")
def _(spark, sf):
    return D.shared(spark, sf, "page_texts").select("doc", "page", C.collapse_blank_lines("text").alias("text"), C.single_spaced("text").alias("one_line"))


TIDY = "regexp_replace(regexp_replace({}, '  +', ' ', 'g'), ' \\n', chr(10), 'g')"


@register("c04_tidy_spaces", f"{D.with_shared('md_parts')}, md_docs AS ({D.DOC_SQL['md_docs']}) SELECT source, {TIDY.format('md')} AS md FROM md_docs")
def _(spark, sf):
    return D.markdown_docs(spark, sf).select("source", C.tidy_spaces("md").alias("md"))


GLUE = r"(#{1,3}[ \t]+\p{Lu}\p{L}*\p{Ll})(\p{Lu})"
GLUE_COMPAT = r"(#{1,3}\s+)([A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ]+)([A-ZÁÉÍÓÚÑ])"


@register("c05_glued_headings", rf"""{D.with_shared('ocr_lines')} SELECT line_no, regexp_replace(line, {lit(GLUE)}, '\1 \2', 'g') AS line,
regexp_replace(line, {lit(GLUE_COMPAT)}, '\1\2 \3', 'g') AS compat_line FROM ocr_lines""")
def _(spark, sf):
    return D.shared(spark, sf, "ocr_lines").select("line_no", C.split_glued_heading("line").alias("line"),
                                                   C.split_glued_heading("line", compat=True).alias("compat_line"))


IMAGE_DOCS = "image_docs AS (SELECT source, string_agg(part, '' ORDER BY ord) AS md FROM image_parts GROUP BY source)"


def _image_docs(spark, sf):
    return D._joined(D.shared(spark, sf, "image_parts"), "source", "ord", "part", "md")


@register("c06_numbered_image_placeholders", f"""{D.with_shared('image_parts')}, {IMAGE_DOCS},
cut AS (SELECT source, string_split_regex(md, {lit(X.INLINE_IMAGE)}) AS p FROM image_docs)
SELECT source, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE '[IMAGEN_' || CAST(i - 1 AS VARCHAR) || ']' || x END), '') AS md FROM cut""")
def _(spark, sf):
    return _image_docs(spark, sf).select("source", C.number_inline_images("md").alias("md"))


HEAD = lit("(?i)" + X.OCR_HEADING)


@register("c07_ocr_heading_repair", rf"""{D.with_shared('ocr_lines')},
h AS (SELECT line_no, line, regexp_matches(line, {HEAD}) AS hit, regexp_extract(line, {HEAD}, 2) AS no, trim(regexp_extract(line, {HEAD}, 3)) AS t FROM ocr_lines),
w AS (SELECT *, array_to_string(list_transform(list_filter(string_split_regex({repairs('t')}, '\s+'), lambda w: w <> ''),
  lambda w: CASE WHEN length(w) > 15 THEN regexp_replace(w, '([a-záéíóúñ])([A-ZÁÉÍÓÚÑ])', '\1 \2', 'g') ELSE w END), ' ') AS j FROM h)
SELECT line_no, CASE WHEN hit THEN '## Articulo ' || CASE WHEN regexp_matches(no, '^\d+o$') THEN CAST(CAST(regexp_replace(no, 'o$', '') AS INT) AS VARCHAR) || '0' ELSE no END
  || '. ' || regexp_replace(upper(substr(j, 1, 1)) || substr(j, 2), '^[°. ]+', '') || '.' ELSE {repairs('line')} END AS line FROM w""")
def _(spark, sf):
    return D.shared(spark, sf, "ocr_lines").select("line_no", C.repair_ocr_heading("line").alias("line"))


@register("c08_ocr_body_repair_log", f"""{D.with_shared('ocr_lines')} SELECT line_no, line AS before, {repairs('line')} AS after FROM ocr_lines
WHERE line <> {repairs('line')}""")
def _(spark, sf):
    d = D.shared(spark, sf, "ocr_lines").select("line_no", F.col("line").alias("before"), C.repair_ocr_body("line").alias("after"))
    return d.filter("before <> after")


@register("c09_accent_strip_upper", "SELECT doc_id, upper(replace(strip_accents(text), 'ß', 'ss')) AS text FROM documents")
def _(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", C.cadastre_upper("text").alias("text"))


def _article_case(order: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(upper(name), {lit(a)}) THEN substr(name, {len(a) + 1})" for a in order) + " ELSE name END"


@register("c10_street_article", f"""WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'DE LA ' WHEN 1 THEN 'do ' WHEN 2 THEN 'DE ' WHEN 3 THEN 'LAS '
WHEN 4 THEN 'D''' WHEN 5 THEN 'De A ' ELSE '' END || 'PAZ ' || c_mktsegment AS name FROM customer)
SELECT id, {_article_case(sorted(X.STREET_ARTICLES, key=lambda a: -len(a)))} AS name, {_article_case(X.STREET_ARTICLES)} AS compat_name FROM s""")
def _(spark, sf):
    s = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.expr(
        "element_at(array('DE LA ', 'do ', 'DE ', 'LAS ', \"D'\", 'De A ', ''), cast(c_custkey % 7 + 1 as int))"), F.lit("PAZ "), "c_mktsegment").alias("name"))
    return s.select("id", C.drop_street_article("name").alias("name"), C.drop_street_article("name", compat=True).alias("compat_name"))


REF = "lower('30' || substr(md5(c_name), 1, 5) || ' ' || substr(md5(c_name), 6, 7) || CASE WHEN c_custkey % 3 = 0 THEN ' 0001ab' WHEN c_custkey % 3 = 1 THEN '' ELSE 'x' END)"
CLEAN_REF = "upper(replace(ref, ' ', ''))"


@register("c11_reference_cleanup", f"WITH r AS (SELECT c_custkey AS id, {REF} AS ref FROM customer) SELECT id, {CLEAN_REF} AS ref, substr({CLEAN_REF}, 1, 14) AS parcel FROM r")
def _(spark, sf):
    r = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(REF).alias("ref"))
    return r.select("id", C.clean_reference("ref").alias("ref"), C.parcel_key("ref").alias("parcel"))


@register("c12_reference_kind", f"""WITH r AS (SELECT c_custkey AS id, {REF} AS ref, c_mktsegment AS seg FROM customer)
SELECT id, CASE length({CLEAN_REF}) WHEN 14 THEN 'parcel' WHEN 20 THEN 'unit' ELSE 'unknown' END AS kind,
CASE WHEN seg = 'BUILDING' THEN 'Urbano' ELSE 'Rústico' END AS land FROM r""")
def _(spark, sf):
    r = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(REF).alias("ref"), "c_mktsegment")
    code = F.when(F.col("c_mktsegment") == "BUILDING", "UR").otherwise("RU")
    return r.select("id", C.reference_kind("ref").alias("kind"), C.land_kind(code).alias("land"))


AREA = "CAST(CAST(floor(p_retailprice) AS BIGINT) AS {S}) || CASE WHEN p_partkey % 3 = 0 THEN ',25' WHEN p_partkey % 3 = 1 THEN '' ELSE ' m2' END"


@register("c13_decimal_comma", f"SELECT p_partkey AS id, coalesce(TRY_CAST(replace({AREA.format(S='VARCHAR')}, ',', '.') AS DOUBLE), -1) AS area FROM part")
def _(spark, sf):
    a = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(AREA.format(S="STRING")).alias("raw"))
    return a.select("id", F.coalesce(C.decimal_comma("raw"), F.lit(-1.0)).alias("area"))


def unit_code_sql(e: str) -> str:
    v = f"upper(trim(coalesce({e}, '')))"
    return f"CASE WHEN regexp_matches({v}, '^[0-9]+$') THEN coalesce(nullif(ltrim({v}, '0'), ''), '0') ELSE {v} END"


@register("c14_unit_code", f"""{D.with_shared('units')} SELECT building, pos, {unit_code_sql('floor')} AS floor_code, {unit_code_sql('door')} AS door_code FROM units""")
def _(spark, sf):
    return D.shared(spark, sf, "units").select("building", "pos", C.unit_code("floor").alias("floor_code"), C.unit_code("door").alias("door_code"))


@register("c15_url_file_name", r"""WITH p AS (SELECT page_id, replace(replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/', '_'), '\', '_') AS path FROM pages),
n AS (SELECT page_id, CASE WHEN path IN ('', '_') THEN 'index' ELSE path END AS name FROM p)
SELECT page_id, ltrim(CASE WHEN suffix(name, '.html') THEN name ELSE name || '.html' END, '_') AS file_key FROM n""")
def _(spark, sf):
    return R.pages(spark, f"{sf}/pages.parquet").select("page_id", "file_key")


def address_sql(e: str) -> str:
    head = f"string_split(string_split(coalesce({e}, ''), 'Es:')[1], '(')[1]"
    bare = f"replace(replace(regexp_replace({head}, '\\d+', '', 'g'), 'VIGO', ''), 'PONTEVEDRA', '')"
    return f"upper(array_to_string(list_filter(string_split_regex({bare}, '\\s+'), lambda w: w <> '')[1:4], ' '))"


@register("c16_comparable_address", f"{D.with_shared('addresses')} SELECT address_id, {address_sql('address')} AS address FROM addresses")
def _(spark, sf):
    return D.shared(spark, sf, "addresses").select("address_id", C.comparable_address("address").alias("address"))


@register("c17_different_streets", f"""{D.with_shared('addresses')}, p AS (SELECT a.address_id, {address_sql('a.address')} AS x, {address_sql('b.address')} AS y
FROM addresses a JOIN addresses b ON b.address_id = a.address_id + 1)
SELECT address_id, x <> '' AND y <> '' AND len(list_intersect(string_split(x, ' '), string_split(y, ' '))) < 2 AS different FROM p""")
def _(spark, sf):
    a = D.shared(spark, sf, "addresses")
    b = a.select((F.col("address_id") - 1).alias("address_id"), F.col("address").alias("other"))
    return a.join(b, "address_id").select("address_id", C.different_streets("address", "other").alias("different"))


@register("c18_card_snippets", r"""SELECT doc_id, CASE WHEN length(string_split(text, chr(10) || chr(10))[1]) > 350 THEN substr(string_split(text, chr(10) || chr(10))[1], 1, 350) || '...'
ELSE string_split(text, chr(10) || chr(10))[1] END AS card, trim(list_last(string_split(source || ' | ' || lang, '|'))) AS title,
CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS listed FROM documents""")
def _(spark, sf):
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", C.card_text("text").alias("card"), C.card_title(F.concat_ws(" | ", "source", "lang")).alias("title"),
                    C.truncate("text", 200).alias("listed"))


@register("c19_slugs_and_paths", f"""{D.with_shared('code_parts')} SELECT source, ord, 'art-' || replace('3.' || CAST(ord AS VARCHAR), '.', '-') AS slug,
'wiki/' || regexp_replace(source, '^cte-', 'cte/') || '/art-' || CAST(ord AS VARCHAR) || '.md' AS path FROM code_parts""")
def _(spark, sf):
    n = F.col("ord").cast("string")
    return D.shared(spark, sf, "code_parts").select("source", "ord", C.article_slug(F.concat(F.lit("3."), n)).alias("slug"),
                                                    C.wiki_path("source", n).alias("path"))


@register("c20_length_caps", """SELECT doc_id, length(text) > 8000 AS partial, md5(substr(text, 1, 600)) AS prompt_part,
length(CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '...' ELSE text END) AS capped FROM documents""")
def _(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", C.is_partial("text").alias("partial"), F.md5(F.substring("text", 1, 600)).alias("prompt_part"),
                                                  F.length(C.truncate("text", X.SECTION_CHARS)).cast("long").alias("capped"))


ANSWER = """CASE p_partkey % 4 WHEN 0 THEN '{{"resumen": "' || p_name || '", "tags": ["' || p_type || '"]}}' WHEN 1 THEN '```json' || chr(10) || '{{"resumen": "x ' || p_name || '"}}' || chr(10) || '```'
WHEN 2 THEN '<think>duda {{</think> {{"resumen": "' || p_brand || '"}}' ELSE 'sin formato ' || p_name END"""
CLEAN_ANSWER = strip("regexp_replace(regexp_replace(" + strip("raw") + r", '(?s)<think>.*?</think>', '', 'g'), '```\w*\s*', '', 'g')")


@register("c21_model_answers", f"""WITH a AS (SELECT p_partkey AS id, {ANSWER.format()} AS raw FROM part), t AS (SELECT id, {CLEAN_ANSWER} AS txt FROM a)
SELECT id, CASE WHEN json_valid(txt) THEN json_extract_string(txt, '$.resumen') ELSE txt END AS summary, json_valid(txt) AS parsed FROM t""")
def _(spark, sf):
    from regspark.operators.enrich import parse_wiki_answer

    a = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(ANSWER.format()).alias("raw"))
    return a.select("id", parse_wiki_answer("raw")["resumen"].alias("summary"), F.try_parse_json(C.model_json_text("raw")).isNotNull().alias("parsed"))


LISTED = "'1. ¿Qué ' || p_name || ' permite?' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '- ¿y?' || chr(10) ELSE '' END || '* ¿Cuánto mide ' || p_type || '?' || chr(10) || '3. ¿Otra más sobre ' || p_brand || '?'"


@register("c22_question_lists", rf"""WITH a AS (SELECT p_partkey AS id, {LISTED} AS raw FROM part)
SELECT id, array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda s: regexp_replace(trim(s), '^[\d.\-*]+\s*', '')),
lambda s: length(s) > 10 AND contains(s, '?'))[1:2], '|') AS questions FROM a""")
def _(spark, sf):
    a = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(LISTED).alias("raw"))
    return a.select("id", F.array_join(C.clean_questions("raw"), "|").alias("questions"))


@register("c23_tags", """SELECT p_partkey AS id, '#' || replace(p_name, ' ', '_') || ' #' || p_type AS tags, '"' || p_name || '", "' || p_type || '"' AS yaml FROM part""")
def _(spark, sf):
    arr = F.array("p_name", "p_type")
    return D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.tag_line(arr).alias("tags"), C.yaml_list(arr).alias("yaml"))


# ------------------------------------------------------------------ features


def flag_sql(text: str) -> dict[str, str]:
    return {n: "(" + " OR ".join(f"contains(lower({text}), {lit(t)})" for t in terms) + ")" for n, _, terms in X.CONCEPTS}


@register("f01_concept_flags", f"{D.with_shared('md_parts')} SELECT source, ord, " + ", ".join(f"{e} AS {n}" for n, e in flag_sql("part").items()) + " FROM md_parts")
def _(spark, sf):
    return D.shared(spark, sf, "md_parts").select("source", "ord", *[c.alias(n) for n, c in FE.concept_flags("part").items()])


def scope_sql(text: str, chapter: str) -> str:
    t, c = f"strip_accents(lower({text}))", f"strip_accents(lower({chapter}))"

    def has(x: str, s: str) -> str:
        return f"contains({x}, '{s}')"

    return (f"CASE WHEN {has(t, 'urbano consolidado')} OR {has(c, 'urbano consolidado')} THEN 'urbano_consolidado' "
            f"WHEN {has(t, 'urbano no consolidado')} THEN 'urbano_no_consolidado' "
            f"WHEN {has(t, 'nucleo rural')} OR {has(c, 'nucleo rural')} THEN 'nucleo_rural' "
            f"WHEN {has(t, 'rustico')} OR {has(c, 'rustico')} THEN 'rustico' "
            f"WHEN {has(t, 'suelo urbano')} OR {has(c, 'suelo urbano')} THEN 'urbano' ELSE '' END")


@register("f02_land_scope", f"{D.with_shared('md_parts')} SELECT source, ord, {scope_sql('part', 'source')} AS scope FROM md_parts")
def _(spark, sf):
    return D.shared(spark, sf, "md_parts").select("source", "ord", FE.land_scope("part", "source").alias("scope"))


@register("f03_ordinance_code", rf"""{D.with_shared('md_parts')} SELECT source, ord, regexp_extract(part, '\b[Oo]rdenanza\s+({X.ORDINANCE_CODE})\b', 1) AS code,
string_split(regexp_extract(part, '\b[Oo]rdenanza\s+({X.ORDINANCE_CODE})\b', 1), '.')[1] AS family FROM md_parts""")
def _(spark, sf):
    code = FE.ordinance_code(F.lit(""), "part")
    return D.shared(spark, sf, "md_parts").select("source", "ord", code.alias("code"), FE.ordinance_family(code).alias("family"))


def keywords_sql(text: str) -> str:
    vocabulary = "[" + ", ".join(lit(w) for w in X.VOCABULARY) + "]"
    parts = [f"list_filter({vocabulary}, lambda w: contains(lower({text}), w))"]
    for p in X.MEASURES:
        parts.append(f"list_transform(list_zip(regexp_extract_all(lower({text}), {lit(p)}, 1), regexp_extract_all(lower({text}), {lit(p)}, 2)), lambda z: z[1] || ' ' || z[2])")
    parts.append(f"list_transform(regexp_extract_all(upper({text}), {lit(chr(92) + 'b(' + X.ORDINANCE_CODE_COMPAT + ')' + chr(92) + 'b')}, 1), lambda z: lower(z))")
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    return f"list_sort(list_distinct({joined}))"


@register("f04_keywords", f"{D.with_shared('md_parts')} SELECT source, ord, array_to_string(({keywords_sql('part')})[1:8], ', ') AS keywords FROM md_parts")
def _(spark, sf):
    return D.shared(spark, sf, "md_parts").select("source", "ord", F.array_join(FE.keywords("part"), ", ").alias("keywords"))


REQUEST = "coalesce(" + ", ".join(f"nullif(regexp_extract(lower(text), {lit(p)}, 1), '')" for p in X.ARTICLE_REQUESTS) + ", '')"


@register("f05_article_request", f"{D.with_shared('questions')} SELECT query_id, {REQUEST} AS article FROM questions")
def _(spark, sf):
    return D.shared(spark, sf, "questions").select("query_id", F.coalesce(FE.requested_article("text"), F.lit("")).alias("article"))


@register("f06_source_class", f"""{D.with_shared('md_parts', 'code_parts')}, s AS (SELECT source FROM code_parts UNION SELECT source FROM md_parts UNION SELECT DISTINCT CASE WHEN lang = 'en' THEN 'pxom' ELSE 'nhv' END FROM documents)
SELECT source, CASE WHEN source = 'pxom' THEN 'pxom' WHEN source = 'nhv' THEN 'nhv' WHEN starts_with(source, 'cte') THEN 'cte' ELSE '' END AS class FROM s""")
def _(spark, sf):
    other = D.table(spark, sf, "documents").select(F.when(F.col("lang") == "en", "pxom").otherwise("nhv").alias("source"))
    s = D.shared(spark, sf, "code_parts").select("source").union(D.shared(spark, sf, "md_parts").select("source")).union(other).distinct()
    return s.select("source", FE.source_class("source").alias("class"))


def street_sql(field: str) -> str:
    out = "CASE "
    for code, words, pattern, alternates in X.STREET_TYPES:
        cond = " OR ".join(f"contains(lower(address), {lit(w)})" for w in words)
        value = {"type": lit(code), "name": f"upper(trim(regexp_extract(address, {lit('(?i)' + pattern)}, 1)))", "types": lit(",".join([code] + alternates))}[field]
        out += f"WHEN {cond} THEN {value} "
    return out + {"type": "ELSE 'RU' END", "name": "ELSE '' END", "types": f"ELSE {lit(','.join(['RU'] + X.STREET_TYPES[0][3]))} END"}[field]


@register("f07_street_type", f"{D.with_shared('addresses')} SELECT address_id, {street_sql('type')} AS street_type, {street_sql('name')} AS street_name, {street_sql('types')} AS types FROM addresses")
def _(spark, sf):
    s = FE.street_type("address")
    return D.shared(spark, sf, "addresses").select("address_id", s["type"].alias("street_type"), F.coalesce(s["name"], F.lit("")).alias("street_name"),
                                                   F.array_join(s["types"], ",").alias("types"))


PREFIX_LEN = "CASE " + " ".join(f"WHEN starts_with(trim(lower(address)), {lit(p)}) THEN {len(p)}" for p in X.ADDRESS_PREFIXES) + " ELSE 0 END"


def spelled(kinds: list[str]) -> str:
    return ", ".join(f"{lit(k + ' ')} || name || tail" for k in kinds)


@register("f08_address_variants", rf"""{D.with_shared('addresses')}, b AS (SELECT address_id, address, regexp_extract(address, '\s+(\d+)\s*$', 1) AS no, {PREFIX_LEN} AS n FROM addresses),
c AS (SELECT *, CASE WHEN no <> '' THEN regexp_replace(address, '\s+\d+\s*$', '') ELSE address END AS base FROM b),
d AS (SELECT *, trim(substr(base, n + 1)) AS name, CASE WHEN no <> '' THEN ' ' || no ELSE '' END AS tail FROM c),
e AS (SELECT address_id, list_filter(list_transform(CASE WHEN n > 0 OR name <> base THEN [address, {spelled(X.TYPED_REWRITES)}, name || tail]
  ELSE [address, {spelled(X.UNTYPED_REWRITES)}] END, lambda v: trim(v)), lambda v: v <> '') AS v FROM d),
f AS (SELECT address_id, list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i) AS v FROM e)
SELECT address_id, unnest(range(len(v))) AS ord, unnest(v) AS variant FROM f""")
def _(spark, sf):
    return D.shared(spark, sf, "addresses").select("address_id", F.posexplode(FE.address_variants("address")).alias("ord", "variant"))


BARE = r"trim(regexp_replace(address, '\b\d+\b', '', 'g'))"
NAME_ONLY = "CASE " + " ".join(f"WHEN starts_with(lower({BARE}), {lit(p)}) THEN trim(substr({BARE}, {len(p) + 1}))" for p in X.FALLBACK_PREFIXES) + f" ELSE {BARE} END"


@register("f09_house_number", rf"{D.with_shared('addresses')} SELECT address_id, regexp_extract(address, '\b(\d+)\b', 1) AS house_number, trim({NAME_ONLY}, ' ,') AS street FROM addresses")
def _(spark, sf):
    return D.shared(spark, sf, "addresses").select("address_id", FE.house_number("address").alias("house_number"), FE.street_name_only("address").alias("street"))


def expansion_sql(text: str) -> str:
    low = f"lower({text})"
    lists = []
    for term, syns in D.DICTIONARY:
        arr = "[" + ", ".join(lit(s) for s in syns) + "]"
        lists.append(f"CASE WHEN contains({low}, {lit(term)}) THEN list_filter({arr}, lambda s: NOT contains({low}, s)) ELSE [] END")
    return "flatten([" + ", ".join(lists) + "])"


@register("f10_query_expansion", f"""{D.with_shared('questions')}, e AS (SELECT query_id, text, {expansion_sql('text')} AS added FROM questions),
u AS (SELECT *, list_filter(added, lambda x, i: list_position(added, x) = i) AS uniq FROM e)
SELECT query_id, CASE WHEN len(uniq) > 0 THEN text || ' ' || array_to_string(uniq, ' ') ELSE text END AS expanded FROM u""")
def _(spark, sf):
    return D.shared(spark, sf, "questions").select("query_id", FE.expand_query("text", D.DICTIONARY).alias("expanded"))


@register("f10_j12_dictionary_join", ORACLES["f10_query_expansion"])
def _(spark, sf):
    """The dictionary as a table, met by anchors."""
    q = D.shared(spark, sf, "questions").select("query_id", "text")
    return terms.expand_questions(q, terms.dictionary_table(spark, D.DICTIONARY)).select("query_id", "expanded")


DETECTED = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(text), {lit(t)}) AND len(list_filter([{', '.join(lit(x) for x in s)}], lambda s: NOT contains(lower(text), s))) > 0 THEN {lit(t)} ELSE '' END"
    for t, s in D.DICTIONARY) + "], lambda x: x <> ''), ',')"


@register("f10_query_expansion_matches", f"{D.with_shared('questions')} SELECT query_id, {DETECTED} AS terms FROM questions")
def _(spark, sf):
    m = FE.expansion_matches("text", D.DICTIONARY)
    return D.shared(spark, sf, "questions").select("query_id", F.array_join(F.transform(m, lambda h: h["term"]), ",").alias("terms"))


@register("f11_rerank_query", f"""{D.with_shared('questions')} SELECT query_id, CASE WHEN {' OR '.join(f"contains(lower(text), '{t}')" for t in X.RERANK_TERMS)}
THEN {lit(X.RERANK_PREFIX)} || text ELSE text END AS text FROM questions""")
def _(spark, sf):
    return D.shared(spark, sf, "questions").select("query_id", FE.rerank_query("text").alias("text"))


@register("f12_ordinance_alias", f"{D.with_shared('questions')} SELECT query_id, CASE WHEN code IN ('U1.1', 'U1.2') THEN 'U1' ELSE code END AS code FROM questions")
def _(spark, sf):
    return D.shared(spark, sf, "questions").select("query_id", FE.alias_ordinance("code").alias("code"))


@register("f13_query_enrichment", f"""{D.with_shared('questions')} SELECT query_id, CASE WHEN code <> '' THEN text || ' ordenanza ' || code ELSE text END AS zoned,
'Parcela RC P' || CAST(query_id AS VARCHAR) || ', ordenanza ' || code || ', superficie 120 m², usos actuales: ' || CASE WHEN query_id % 2 = 0 THEN 'VIVIENDA, ' || language ELSE 'N/D' END || '. ' || trim(text) AS full_text FROM questions""")
def _(spark, sf):
    uses = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("VIVIENDA"), F.col("language"))).otherwise(F.array().cast("array<string>"))
    full = FE.enrich_with_parcel(F.col("text"), F.concat(F.lit("P"), F.col("query_id").cast("string")), F.col("code"), F.lit("120"), uses)
    return D.shared(spark, sf, "questions").select("query_id", FE.enrich_with_zone("text", "code").alias("zoned"), full.alias("full_text"))


CENSUS = {"titles": X.PLAIN_TITLE, "chapters": X.PLAIN_CHAPTER, "sections": X.PLAIN_SECTION, "articles": r"Art\.\s+(\d+[a-z]?)\.\s+([^\n.]+)\."}


@register("f14_heading_census", f"{D.with_shared('page_texts')}, plain_docs AS ({D.DOC_SQL['plain_docs']}) SELECT doc, " + ", ".join(
    f"len(regexp_extract_all(text, {lit('(?i)' + p)})) AS {n}" for n, p in CENSUS.items()) + " FROM plain_docs")
def _(spark, sf):
    return D.plain_docs(spark, sf).select("doc", *[c.alias(n) for n, c in FE.heading_census("text").items()])


@register("f15_key_fields", f"""{D.with_shared('md_parts')} SELECT source, ord, {' OR '.join(f"contains(lower(part), '{t}')" for t in X.KEY_FIELD_TOKENS)} AS key_field FROM md_parts""")
def _(spark, sf):
    return D.shared(spark, sf, "md_parts").select("source", "ord", FE.is_key_field("part").alias("key_field"))


# ------------------------------------------------------------------ sources on given tables


RAW = """CASE doc_id % 4 WHEN 0 THEN '{{"document": {{"md_content": "' || source || ' ' || lang || '"}}}}' WHEN 1 THEN '{{"output": {{"markdown": "' || source || '"}}}}'
WHEN 2 THEN '{{"markdown": "' || lang || '"}}' ELSE '{{"other": "' || source || '"}}' END"""


@register("s03_converted_markdown", f"""WITH r AS (SELECT doc_id, {RAW.format()} AS raw FROM documents) SELECT doc_id, coalesce(json_extract_string(raw, '$.document.md_content'),
json_extract_string(raw, '$.output.markdown'), json_extract_string(raw, '$.markdown'), substr(raw, 1, 2000)) AS md FROM r""")
def _(spark, sf):
    r = D.table(spark, sf, "documents").select("doc_id", F.expr(RAW.format()).alias("raw"))
    return r.select("doc_id", R.converted_markdown("raw").alias("md"))


@register("s04_image_map_rows", f"""{D.with_shared('image_map')} SELECT source, img_key, url FROM image_map""")
def _(spark, sf):
    m = D.shared(spark, sf, "image_map").groupBy("source").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("img_key", "url")))).alias("raw"))
    return R.image_map(m)


@register("s05_page_keys", r"""WITH p AS (SELECT page_id, url, md5(html) AS html_md5, replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/', '_') AS path FROM pages)
SELECT page_id, html_md5, ltrim(CASE WHEN path IN ('', '_') THEN 'index' ELSE path END || CASE WHEN suffix(path, '.html') THEN '' ELSE '.html' END, '_') AS file_key FROM p""")
def _(spark, sf):
    return R.pages(spark, f"{sf}/pages.parquet").select("page_id", F.md5("html").alias("html_md5"), "file_key")


HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"


@register("s06_page_links", f"""WITH h AS (SELECT page_id, url AS base, regexp_extract_all(replace(replace(html, '">', '.html">'), '/the.html', 'the.pdf'), {lit(HREF)}, 1) AS l FROM pages),
r AS (SELECT page_id, base, unnest(range(len(l))) AS pos, unnest(l) AS href FROM h),
k AS (SELECT page_id, pos, CASE WHEN suffix(href, '.html') THEN 'html' ELSE 'pdf' END AS kind, CASE WHEN NOT suffix(href, '.html') THEN href
  WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(base, '^([a-zA-Z]+://[^/?#]*)', 1) || href
  ELSE regexp_extract(base, '^([a-zA-Z]+://[^?#]*/)', 1) || href END AS link FROM r WHERE suffix(href, '.html') OR suffix(href, '.pdf'))
SELECT page_id, kind, link, min(pos) AS pos FROM k GROUP BY ALL""")
def _(spark, sf):
    p = D.table(spark, sf, "pages").withColumn("html", F.replace(F.replace("html", F.lit('">'), F.lit('.html">')), F.lit("/the.html"), F.lit("the.pdf")))
    return R.links(p)


@register("k12_deduplicated_images", f"""{D.with_shared('image_parts')}, {IMAGE_DOCS},
m AS (SELECT source, regexp_extract_all(md, {lit(X.INLINE_IMAGE_PARTS)}, 1) AS e, regexp_extract_all(md, {lit(X.INLINE_IMAGE_PARTS)}, 2) AS b FROM image_docs),
i AS (SELECT source, unnest(range(1, len(e) + 1)) AS image_no, unnest(e) AS ext, unnest(b) AS b64 FROM m), h AS (SELECT source, image_no, ext, md5(from_base64(b64)) AS hash FROM i)
SELECT source, image_no, 'IMAGEN_' || CAST(image_no AS VARCHAR) AS img_key, hash,
first_value(source || '/imagen_' || CAST(image_no AS VARCHAR) || '.' || ext) OVER (PARTITION BY source, hash ORDER BY image_no) AS file FROM h""")
def _(spark, sf):
    return R.deduplicated_images(_image_docs(spark, sf))
