"""Retrieval, prompt and provider queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.operators import cells, chat, enrich, terms
from regspark.operators import retrieve as V
from regspark.operators import segment as S
from regspark.operators.refs import extract_references, number_parts, reference_list
from regspark.plans import derive as D
from regspark.plans import retrieval as P
from regspark.plans.catalog import ORACLES, lit, register
from regspark.plans.catalog_segment import CHUNKS, ITEMS, REFS, _chunks, _md, _real, _refs, MD_ART
from regspark.plans.catalog_text import CLEAN_ANSWER, keywords_sql, strip
from regspark.providers import HashingEmbedding, WordOverlapScore, add_embeddings, score_column
from regspark.session import cut_lineage, ensure_checkpoint_dir
from regspark.sources import files

BASE = "WITH " + D.VECTOR_SQL


def topk(where: str = "score >= 0.3", k: int = 20, name: str = "hits") -> str:
    return (f"{name} AS (SELECT query_id, view, chunk_id, score, row_number() OVER (PARTITION BY query_id, view ORDER BY score DESC, chunk_id) AS rank "
            f"FROM sims WHERE {where} QUALIFY rank <= {k})")


def fused(hits: str = "hits", name: str = "fused") -> str:
    return f"{name} AS (SELECT query_id, chunk_id, round(sum(1e0 / (60 + rank)), 9) AS rrf_score FROM {hits} GROUP BY ALL)"


def final(k: int, src: str = "fused", name: str = "fin") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM {src} QUALIFY rank <= {k})"


@register("v01_j13_three_view_search", f"{BASE}, {topk()} SELECT query_id, view, chunk_id, rank, round(score, 6) AS score FROM hits")
def _(spark, sf):
    h = V.similarity_hits(D.benchmark_queries(spark, sf), D.vector_chunks(spark, sf))
    return h.select("query_id", "view", "chunk_id", "rank", F.round("score", 6).alias("score"))


@register("v01_tiled_search", f"{BASE}, {topk()} SELECT query_id, view, chunk_id, rank, round(score, 6) AS score FROM hits")
def _(spark, sf):
    # a small block limit sends the same search through the tiled plan used for large query sets
    h = V.similarity_hits(D.benchmark_queries(spark, sf), D.vector_chunks(spark, sf), max_query_bytes=8 * 64 * 16)
    return h.select("query_id", "view", "chunk_id", "rank", F.round("score", 6).alias("score"))


@register("v02_single_view_search", f"{BASE}, {topk('view = ' + lit('text'), 5)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits")
def _(spark, sf):
    h = V.similarity_hits(D.benchmark_queries(spark, sf), D.vector_chunks(spark, sf), 5, None, {"text": "v_text"})
    return h.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@register("v03_payload_filter_search", f"""{BASE}, {topk("score >= 0.3 AND starts_with(source, 'src1') AND scope = 'urbano'")}, {fused()}, {final(5)} SELECT query_id, chunk_id, rank, rrf_score FROM fin""")
def _(spark, sf):
    where = V.payload_filter({"source_prefix": "src1", "scope": "urbano"})
    return V.retrieve(D.benchmark_queries(spark, sf), D.vector_chunks(spark, sf), 5, where).select("query_id", "chunk_id", "rank", "rrf_score")


@register("v04_must_should", f"{BASE} SELECT chunk_id, ordinance_code FROM vchunks WHERE scope = 'urbano' AND (defines_height OR defines_occupation OR defines_buildability)")
def _(spark, sf):
    cond = V.must_should({"scope": "urbano"}, ["defines_height", "defines_occupation", "defines_buildability"])
    return D.vector_chunks(spark, sf).filter(cond).select("chunk_id", "ordinance_code")


@register("v05_several_collections", f"""{BASE}, s2 AS (SELECT *, CASE WHEN chunk_id < '8' THEN 'first' ELSE 'second' END AS collection FROM sims WHERE view = 'text'),
h2 AS (SELECT query_id, collection || '::' || chunk_id AS chunk_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, collection || '::' || chunk_id) AS rank FROM s2 WHERE score >= 0.3 QUALIFY rank <= 20)
SELECT query_id, chunk_key, rank, round(score, 6) AS score FROM h2""")
def _(spark, sf):
    c = D.vector_chunks(spark, sf)
    both, unknown = V.in_collections({"first": c.filter("chunk_id < '8'"), "second": c.filter("chunk_id >= '8'")}, ["first", "second", "absent"])
    assert unknown == ["absent"]
    keyed = both.withColumn("chunk_key", F.concat_ws("::", "collection", "chunk_id"))
    h = V.similarity_hits(D.benchmark_queries(spark, sf), keyed, views={"text": "v_text"}, id_col="chunk_key")
    return h.select("query_id", "chunk_key", "rank", F.round("score", 6).alias("score"))


@register("v06_rank_fusion", f"{BASE}, {topk()}, {fused()} SELECT query_id, chunk_id, rrf_score FROM fused")
def _(spark, sf):
    return V.rank_fusion(V.similarity_hits(D.benchmark_queries(spark, sf), D.vector_chunks(spark, sf)))


@register("v07_rerank_off", f"{BASE}, {topk()}, {fused()}, {final(12)} SELECT query_id, chunk_id, rank, rrf_score, rrf_score AS rerank_score FROM fin")
def _(spark, sf):
    f = V.rank_fusion(V.similarity_hits(D.benchmark_queries(spark, sf), D.vector_chunks(spark, sf)))
    return V.rerank(f, 12).select("query_id", "chunk_id", "rank", "rrf_score", "rerank_score")


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
RERANKED = f"CASE WHEN {' OR '.join(f'contains(lower(query), {lit(t)})' for t in X.RERANK_TERMS)} THEN {lit(X.RERANK_PREFIX)} || query ELSE query END"


@register("v07_v08_rerank_on_with_floor", f"""{BASE}, {topk()}, {fused()}, w AS (SELECT query_id, list_distinct({WORDS.format(RERANKED)}) AS asked FROM vqueries),
t AS (SELECT chunk_id, {WORDS.format('text')} AS held FROM vchunks),
s AS (SELECT query_id, chunk_id, CASE WHEN len(asked) > 0 THEN CAST(len(list_intersect(asked, held)) AS DOUBLE) / len(asked) ELSE 0 END AS score FROM fused JOIN w USING (query_id) JOIN t USING (chunk_id))
SELECT query_id, chunk_id, rank, round(score, 6) AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 12) WHERE score >= 5e-2""")
def _(spark, sf):
    q, c = D.benchmark_queries(spark, sf), D.vector_chunks(spark, sf)
    f = V.rank_fusion(V.similarity_hits(q, c)).join(q.select("query_id", "query"), "query_id").join(
        c.select("chunk_id", F.concat("header", F.lit("\n\n"), "text").alias("text_with_header")), "chunk_id")
    out = V.rerank(f, X.TOP_K_SERVICE, score_column(WordOverlapScore()), min_score=X.SERVICE_FLOOR)
    return out.select("query_id", "chunk_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


def _ordinance_vectors(spark, sf):
    e = D.table(spark, sf, "embeddings")
    family = F.concat(F.lit("U"), (F.col("label") + 1).cast("string"))
    v = e.groupBy(family.alias("family")).agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("vector"))
    return v.select(F.explode(F.array(F.col("family"), F.concat("family", F.lit(".A")))).alias("code"), "vector")


@register("v09_ordinance_context", f"""{BASE}, codes AS (SELECT DISTINCT 'U' || CAST(label + 1 AS VARCHAR) AS code FROM embeddings UNION SELECT 'U' || CAST(label + 1 AS VARCHAR) || '.A' FROM embeddings),
cv AS (SELECT code, min(vec_id) AS vec FROM codes JOIN embeddings ON 'U' || CAST(label + 1 AS VARCHAR) = string_split(code, '.')[1] GROUP BY code),
direct AS (SELECT ordinance_code AS code, row_number() OVER (PARTITION BY ordinance_code ORDER BY chunk_id) AS rank, chunk_id, 'filter' AS path FROM vchunks
  WHERE (defines_buildability OR defines_height OR defines_occupation OR defines_setbacks) AND ordinance_code IN (SELECT code FROM codes) QUALIFY rank <= 8),
sem AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), v_text), 9) DESC, chunk_id) AS rank, chunk_id, 'semantic' AS path
  FROM cv JOIN embeddings e ON e.vec_id = cv.vec, vchunks WHERE scope = 'urbano' AND code NOT IN (SELECT code FROM direct) QUALIFY rank <= 6)
SELECT * FROM direct UNION ALL SELECT * FROM sem""")
def _(spark, sf):
    codes = _ordinance_vectors(spark, sf)
    return V.ordinance_context(codes, D.vector_chunks(spark, sf))


@register("v10_zone_filter_with_fallback", f"""{BASE}, {topk("score >= 0.3 AND qcode <> '' AND qcode = ccode", name='fh')}, {topk(name='uh')}, {fused('fh', 'ff')}, {fused('uh', 'uf')}, {final(12, 'ff', 'fr')}, {final(12, 'uf', 'ur')},
fz AS (SELECT query_id, chunk_id, rank, rrf_score, false AS used_fallback FROM fr UNION ALL SELECT query_id, chunk_id, rank, rrf_score, false FROM ur JOIN vqueries USING (query_id) WHERE ordinance_code = '')
SELECT * FROM fz UNION ALL SELECT query_id, chunk_id, rank, rrf_score, true FROM ur WHERE query_id NOT IN (SELECT query_id FROM fz)""")
def _(spark, sf):
    out = V.with_fallback(D.benchmark_queries(spark, sf), D.vector_chunks(spark, sf))
    return out.select("query_id", "chunk_id", "rank", "rrf_score", "used_fallback")


def _cell_index(spark, sf):
    """The collection laid out by cells below the checkpoint folder."""
    return cells.build_index(D.vector_chunks(spark, sf), f"{ensure_checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}", code=F.col("ordinance_code"))


@register("v01_pruned_search", ORACLES["v01_j13_three_view_search"])
def _(spark, sf):
    h = cells.pruned_search(D.benchmark_queries(spark, sf), _cell_index(spark, sf)).hits
    return h.select("query_id", "view", "chunk_id", "rank", F.round("score", 6).alias("score"))


@register("v10_pruned_zone_search", ORACLES["v10_zone_filter_with_fallback"])
def _(spark, sf):
    out = cells.zone_search(D.benchmark_queries(spark, sf), _cell_index(spark, sf))
    return out.select("query_id", "chunk_id", "rank", "rrf_score", "used_fallback")


BLOCKS = {
    "retriever": "'[Fuente ' || CAST(rank AS VARCHAR) || ' - ' || source || '] Artículo ' || article_no || ' - ' || ordinance_code || chr(10) || header || chr(10) || text",
    "service": "'### [Fuente ' || CAST(rank AS VARCHAR) || '] ' || source || ' | Art. ' || article_no || CASE WHEN ordinance_code <> '' THEN ' | Ordenanza: ' || ordinance_code ELSE '' END || CASE WHEN scope <> '' THEN chr(10) || 'Capítulo: ' || scope ELSE '' END || chr(10) || 'Título: ' || header || chr(10) || chr(10) || text",
    "basic": "'Fragmento ' || CAST(rank AS VARCHAR) || ' - Art. ' || article_no || chr(10) || CASE WHEN ordinance_code <> '' THEN 'Ordenanza: ' || ordinance_code || chr(10) ELSE '' END || header || chr(10) || text || chr(10) || chr(10)",
}


def _context(style: str):
    def run(spark, sf):
        c = D.vector_chunks(spark, sf)
        hits = P.hits_with_payload(V.retrieve(D.benchmark_queries(spark, sf), c, 5), c, ["source", "article_no", "header", "text", "ordinance_code", "scope"])
        hits = hits.withColumns({"ordinance": F.col("ordinance_code"), "norm_title": F.lit(""), "chapter": F.col("scope"),
                                 "section": F.lit(""), "tables": F.lit("")})
        return V.assemble_context(hits, style)
    return run


for _style, _block in BLOCKS.items():
    _sep = "''" if _style == "basic" else "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    register(f"v11_context_{_style}", f"{BASE}, {topk()}, {fused()}, {final(5)} SELECT query_id, array_to_string(list({_block} ORDER BY rank), {_sep}) AS context FROM fin JOIN vchunks USING (chunk_id) GROUP BY query_id")(_context(_style))


def card_level(label: str, col: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN '- {label} ' || string_split({col}, '|')[1] || ': ' || string_split({col}, '|')[2] || chr(10) ELSE '' END"


@register("v12_article_cards", f"""{REFS}, {ITEMS}, rl AS (SELECT doc, number, list('Art. ' || ref_number ORDER BY CAST(regexp_extract(ref_number, '^(\\d+)', 1) AS INT), TRY_CAST(regexp_extract(ref_number, '\\.(\\d+)$', 1) AS INT) NULLS FIRST) AS rs FROM refs GROUP BY ALL)
SELECT i.doc, i.number, '## Articulo ' || i.number || ': ' || heading || chr(10) || chr(10) || '**Contexto:**' || chr(10) || {card_level('Titulo', 'title')} || {card_level('Capitulo', 'chapter')} || {card_level('Seccion', 'section')}
|| chr(10) || '**Contenido:**' || chr(10) || chr(10) || CASE WHEN len(ps) >= 2 THEN array_to_string(list_transform(its, lambda x: '**' || x.number || '.** ' || x.text || chr(10) || chr(10)), '') ELSE body || chr(10) || chr(10) END
|| CASE WHEN len(coalesce(rs, [])) > 0 THEN '**Referencias:**' || chr(10) || array_to_string(rs[1:10], ', ') || chr(10) ELSE '' END AS card FROM items i LEFT JOIN rl ON rl.doc = i.doc AND rl.number = i.number""")
def _(spark, sf):
    real = cut_lineage(_real(spark, sf))  # written once: cards and references both read it
    a = real.withColumn("structure", S.numbered_paragraphs("body"))
    j = a.join(reference_list(extract_references(real, ["doc", "number"], "body"), ["doc", "number"]), ["doc", "number"], "left")
    j = j.withColumn("refs", F.coalesce("refs", F.array().cast("array<struct<number:string,source:string>>")))
    return j.select("doc", "number", V.article_card().alias("card"))


@register("v13_keyword_search", """SELECT doc_id, len(string_split(lower(text), 'tion')) - 1 AS hits, substr(text, CAST(greatest(strpos(lower(text), 'tion') - 80, 1) AS BIGINT), 160) AS around FROM documents WHERE contains(lower(text), 'tion')""")
def _(spark, sf):
    return V.keyword_search(D.table(spark, sf, "documents"), "tion", body="text").select("doc_id", "hits", "around")


@register("v13_indexed_keyword_search", """WITH t AS (SELECT DISTINCT lower(substr(text, k, 9)) AS term FROM benchmark, (VALUES (1), (20), (41)) AS v(k) WHERE length(substr(text, k, 9)) > 0), d AS (SELECT doc_id, lower(text) AS low FROM documents)
SELECT term, doc_id, CAST(len(string_split(low, term)) - 1 AS BIGINT) AS hits, strpos(low, term) AS first_at FROM t JOIN d ON contains(low, term)""")
def _(spark, sf):
    """Many terms at once against a stored index of every document."""
    folder = f"{ensure_checkpoint_dir(spark)}/terms-{uuid.uuid4().hex}"
    docs = D.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    terms.add_to_index(folder, docs.filter("doc_id % 2 = 0"), "0001", "doc_id", "low")
    terms.add_to_index(folder, docs, "0002", "doc_id", "low")  # half of them again
    asked = D.table(spark, sf, "benchmark").select(F.explode(F.array(*[F.lower(F.substring("text", k, 9)) for k in (1, 20, 41)])).alias("term")).distinct()
    hits = terms.count_apart(F.col("places"), F.length("term")).cast("long")
    return terms.search_index(spark, folder, asked).select("term", F.col("id").alias("doc_id"), hits.alias("hits"), F.col("places")[0].cast("long").alias("first_at"))


@register("v13_keyword_search_title_and_body", f"""{MD_ART} SELECT source, pos, number, (len(string_split(lower(title), 'urgent')) - 1) + (len(string_split(lower(block), 'urgent')) - 1) AS hits FROM art WHERE contains(lower(title), 'urgent') OR contains(lower(block), 'urgent')""")
def _(spark, sf):
    return V.keyword_search(_md(spark, sf), "urgent", "title", "block").select("source", "pos", "number", "hits")


@register("v14_locate_articles", rf"""{D.with_shared('page_texts')}, nums AS (SELECT DISTINCT doc, CAST(page AS VARCHAR) AS number FROM page_texts),
hit AS (SELECT p.doc, number, page, text, coalesce(nullif(strpos(text, 'Art. ' || number || '.'), 0), nullif(strpos(text, 'Art.' || number || '.'), 0), nullif(strpos(text, 'Art ' || number || '.'), 0)) AS at_char
  FROM page_texts p JOIN nums n ON n.doc = p.doc WHERE page >= 7),
f AS (SELECT * FROM hit WHERE at_char IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, number ORDER BY page) = 1),
b AS (SELECT *, substr(text, at_char, 600) AS context, strpos(substr(text, at_char + 20), regexp_extract(substr(text, at_char + 20), 'Art\.\s+\d+\.')) AS nx, regexp_matches(substr(text, at_char + 20), 'Art\.\s+\d+\.') AS has FROM f)
SELECT doc, number, page, at_char, context, CASE WHEN has THEN nx + 19 ELSE length(context) END AS body_chars, CASE WHEN has THEN nx + 19 ELSE length(context) END > 100 AS long_enough FROM b""")
def _(spark, sf):
    pages = D.shared(spark, sf, "page_texts")
    return V.locate_article(pages, pages.select("doc", F.col("page").cast("string").alias("number")).distinct()) \
        .withColumnRenamed("at", "at_char")


@register("v15_evaluation_run")
def _(spark, sf):
    """Every derived question through expansion, hashing vectors and search over the documents."""
    provider = HashingEmbedding(256)
    chunks = D.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "source", "text",
                                                    F.concat(F.lit("U"), (F.col("doc_id") % 9 + 1).cast("string")).alias("ordinance_code"),
                                                    F.col("lang").alias("header"), F.col("doc_id").cast("string").alias("article_no"))
    chunks = chunks.withColumns({"t1": F.col("text"), "t2": F.substring("text", 1, X.SUMMARY_CHARS), "t3": F.concat_ws(" ", "header", "text")})
    chunks = add_embeddings(chunks, {"v_text": "t1", "v_summary": "t2", "v_questions": "t3"}, provider).drop("t1", "t2", "t3")
    q = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit("").alias("code"), F.lit("es").alias("language"),
                                               F.array().cast("array<string>").alias("history"))
    out = P.answer_requests(q, chunks, provider, D.DICTIONARY, "Responde con los fragmentos.", k=5)
    return out.select("query_id", F.length("user").alias("chars"), F.col("fixed_reply").isNotNull().alias("without_hits"))


# ------------------------------------------------------------------ prompts and provider answers


@register("e01_embedding_texts", f"""{CHUNKS} SELECT chunk_id, paragraph_no, CASE WHEN chars % 3 = 0 THEN 'resumen ' || chunk_id ELSE substr(text, 1, 500) END AS view_summary,
CASE WHEN chars % 2 = 0 THEN 'uno? | ' || number ELSE header || ' ' || array_to_string(({keywords_sql('text')})[1:8], ' ') END AS view_questions FROM chunks""")
def _(spark, sf):
    from regspark.functions import features as FE

    c = _chunks(spark, sf).withColumns({
        "summary": F.when(F.col("chars") % 3 == 0, F.concat(F.lit("resumen "), "chunk_id")).otherwise(F.lit("")), "keywords": FE.keywords("text"),
        "questions": F.when(F.col("chars") % 2 == 0, F.array(F.lit("uno?"), F.col("article_no"))).otherwise(F.array().cast("array<string>"))})
    t = enrich.embedding_texts()
    return c.select("chunk_id", "paragraph_no", t["view_summary"].alias("view_summary"), t["view_questions"].alias("view_questions"))


@register("e02_hashing_vectors", r"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}_]') THEN 1e0 ELSE 0e0 END AS norm FROM documents")
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    v = add_embeddings(d, {"vector": "text"}, HashingEmbedding(64))
    return v.select("doc_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


QP, SP = enrich.QUESTION_PROMPT, enrich.SUMMARY_PROMPT


@register("e03_enrichment_prompts", f"""{CHUNKS}, kw AS (SELECT *, ({keywords_sql('text')})[1:8] AS kws FROM chunks) SELECT chunk_id, paragraph_no,
{lit(QP[0])} || substr(text, 1, 600) || {lit(QP[1])} || coalesce(nullif(ordinance_code, ''), 'N/A') || {lit(QP[2])} || coalesce(nullif(array_to_string(kws[1:5], ', '), ''), 'N/A') || {lit(QP[3])} AS question_prompt,
{lit(SP[0])} || substr(text, 1, 600) || {lit(SP[1])} AS summary_prompt FROM kw""")
def _(spark, sf):
    from regspark.functions import features as FE

    c = _chunks(spark, sf).withColumn("keywords", FE.keywords("text"))
    return c.select("chunk_id", "paragraph_no", enrich.question_prompt("text", "ordinance_code", "keywords").alias("question_prompt"),
                    enrich.summary_prompt("text").alias("summary_prompt"))


ERR = "CASE event_type WHEN 'error' THEN 'Error 429: try again in ' || CAST(user_id AS {S}) || '.5s' WHEN 'view' THEN 'HTTP 429 too many' WHEN 'click' THEN 'timeout ' || CAST(event_id AS {S}) END"
HINT = "TRY_CAST(regexp_extract(e, 'try again in ([\\d.]+)s', 1) AS DOUBLE)"
WAIT = f"CASE WHEN contains(e, '429') THEN coalesce({HINT} + 0.5, 5.0) END"


@register("e04_provider_errors", f"""WITH x AS (SELECT event_id, {ERR.format(S='VARCHAR')} AS e FROM events) SELECT event_id, coalesce(CAST({WAIT} AS DOUBLE), -1) AS wait_s,
CASE WHEN e IS NULL THEN 'ok' WHEN {WAIT} > 300 THEN 'quota' WHEN {WAIT} IS NOT NULL THEN 'retry' ELSE 'empty' END AS status FROM x""")
def _(spark, sf):
    x = D.table(spark, sf, "events").select("event_id", F.expr(ERR.format(S="STRING")).alias("e"))
    return x.select("event_id", F.coalesce(enrich.error_wait("e"), F.lit(-1.0)).alias("wait_s"), F.coalesce(enrich.error_status("e"), F.lit("ok")).alias("status"))


PARAM_ANSWER = """CASE p_partkey % 4 WHEN 0 THEN '```json {{"edificabilidad": ' || CAST(p_size AS {S}) || '.5, "altura_maxima": null}}```' WHEN 1 THEN 'no json' WHEN 2 THEN '{{"altura_maxima": ' || CAST(p_size AS {S}) || ', "ocupacion_maxima": 40}}' ELSE '' END"""


@register("e05_parameter_extraction", f"""WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS context, {PARAM_ANSWER.format(S='VARCHAR')} AS raw FROM part),
t AS (SELECT *, {CLEAN_ANSWER} AS txt FROM a), r AS (SELECT *, CASE WHEN context = '' THEN 'sin_chunks' WHEN NOT (json_valid(txt) AND starts_with(txt, '{{')) THEN 'json_error' ELSE 'ok' END AS reason FROM t)
SELECT id, reason, CASE WHEN reason = 'ok' THEN coalesce(TRY_CAST(json_extract_string(txt, '$.edificabilidad') AS DOUBLE), -1) ELSE -1 END AS buildability,
CASE WHEN reason = 'ok' THEN coalesce(TRY_CAST(json_extract_string(txt, '$.altura_maxima') AS DOUBLE), -1) ELSE -1 END AS max_height FROM r""")
def _(spark, sf):
    a = D.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")).alias("context"),
                                          F.expr(PARAM_ANSWER.format(S="STRING")).alias("answer"), F.lit(None).cast("string").alias("error"))
    good, bad = enrich.parse_parameters(a)
    none = F.lit(-1.0)
    ok = good.select(F.col("code").alias("id"), F.lit("ok").alias("reason"), F.coalesce("buildability", none).alias("buildability"), F.coalesce("max_height", none).alias("max_height"))
    return ok.unionByName(bad.select(F.col("code").alias("id"), "reason", none.alias("buildability"), none.alias("max_height")))


class _LengthAnswer:
    """Answers that SQL can give, too: numbers from the length of the request."""

    def complete(self, prompt: str) -> str:
        n = len(prompt)
        return "no lo sé" if n % 5 == 0 else f'```json\n{{"edificabilidad": {n}, "altura_maxima": {n % 9}, "retranqueo_frontal": null}}\n```'


V9 = ORACLES["v09_ordinance_context"].rsplit("SELECT * FROM direct", 1)[0]


@register("e05_parameter_flow", f"""{V9}, picked AS (SELECT * FROM direct UNION ALL SELECT * FROM sem),
ctx AS (SELECT code, string_agg(header || chr(10) || chr(10) || text, {lit(X.BLOCK_SEPARATOR)} ORDER BY rank) AS context FROM picked JOIN vchunks USING (chunk_id) GROUP BY code),
ask AS (SELECT code, length({lit(enrich.PARAMETER_SYSTEM)} || chr(10) || chr(10) || 'Ordenanza: ' || code || chr(10) || chr(10) || 'Normativa:' || chr(10) || context || chr(10) || chr(10) || {lit('Extrae exactamente este JSON:' + chr(10) + enrich.PARAMETER_SCHEMA)}) AS n FROM ctx),
z AS (SELECT item_id AS zone, 'U' || CAST(item_id % 12 + 1 AS VARCHAR) || CASE WHEN item_id % 3 = 0 THEN '.A' ELSE '' END AS ordinance FROM benchmark)
SELECT 'zone' AS kind, CAST(zone AS VARCHAR) AS name, CASE WHEN n % 5 <> 0 THEN CAST(n AS DOUBLE) ELSE -1 END AS buildability, CASE WHEN n % 5 <> 0 THEN CAST(n % 9 AS DOUBLE) ELSE -1 END AS max_height FROM (SELECT zone, coalesce(n, 0) AS n FROM z LEFT JOIN ask ON code = ordinance)
UNION ALL SELECT 'json_error', code, -1, -1 FROM ask WHERE n % 5 = 0 UNION ALL SELECT 'sin_chunks', code, -1, -1 FROM codes WHERE code NOT IN (SELECT code FROM ask)""")
def _(spark, sf):
    codes = _ordinance_vectors(spark, sf)
    chunks = D.vector_chunks(spark, sf).withColumn("text_with_header", F.concat("header", F.lit("\n\n"), "text"))
    i = F.col("item_id")
    name = F.concat(F.lit("U"), (i % 12 + 1).cast("string"), F.when(i % 3 == 0, ".A").otherwise(""))
    run = enrich.parameter_flow(codes, chunks, D.table(spark, sf, "benchmark").select(i.alias("zone"), name.alias("ordinance")), _LengthAnswer())
    none = F.lit(-1.0)
    zones = run.zones.select(F.lit("zone").alias("kind"), F.col("zone").cast("string").alias("name"), F.coalesce("buildability", none).alias("buildability"), F.coalesce("max_height", none).alias("max_height"))
    return zones.unionByName(run.errors.select(F.col("reason").alias("kind"), F.col("code").alias("name"), none.alias("buildability"), none.alias("max_height")))


def _lines(label: str, col: str) -> str:
    return f"CASE WHEN coalesce({col}, '') <> '' THEN '{label}' || {col} || chr(10) ELSE '' END"


READER = "CASE kind " + " ".join(f"WHEN {lit(k)} THEN {lit(t)}" for k, t in enrich.READERS.items()) + f" ELSE {lit(enrich.OTHER_READER)} END"
KINDED = "SELECT *, CASE pos % 4 WHEN 0 THEN 'PXOM' WHEN 1 THEN 'NHV' WHEN 2 THEN 'CTE' ELSE 'OTRO' END AS kind, 'Norma' AS subkind, 'Libro ' || source AS label FROM art"


def _wiki_articles(spark, sf):
    kind = F.when(F.col("pos") % 4 == 0, "PXOM").when(F.col("pos") % 4 == 1, "NHV").when(F.col("pos") % 4 == 2, "CTE").otherwise("OTRO")
    return _md(spark, sf).withColumns({"kind": kind, "subkind": F.lit("Norma"), "label": F.concat(F.lit("Libro "), "source"), "ordinance_code": F.col("context_code")})


@register("e06_wiki_prompts", f"""{MD_ART}, w AS ({KINDED}) SELECT source, pos, 'Eres un experto en ' || {READER} || chr(10) || chr(10) || 'Analiza el siguiente artículo y responde ÚNICAMENTE con un objeto JSON válido.' || chr(10)
|| 'Sin texto adicional, sin bloques markdown, sin ```json.' || chr(10) || chr(10) || 'Documento: ' || label || chr(10) || {_lines('Ordenanza: ', 'context_code')} || {_lines('Capítulo: ', 'chapter')}
|| CASE WHEN length(block) > 8000 THEN {lit(enrich.PARTIAL_NOTICE)} ELSE '' END || chr(10) || 'Artículo: ' || subkind || ' — Art. ' || number || '. ' || title || chr(10) || 'Texto:' || chr(10) || substr(block, 1, 8000)
|| chr(10) || chr(10) || {lit(enrich.WIKI_ANSWER)} AS prompt FROM w""")
def _(spark, sf):
    return _wiki_articles(spark, sf).select("source", "pos", enrich.wiki_prompt().alias("prompt"))


@register("e07_section_prompts", f"""SELECT doc_id, md5('Estructura: ' || CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '...' ELSE text END) AS prompt_md5,
substr({strip("string_split(text, chr(10))[1]")}, 1, 100) AS title, len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p <> '')) AS paragraphs FROM documents""")
def _(spark, sf):
    r = enrich.section_record(F.col("lang"), F.col("text"))
    return D.table(spark, sf, "documents").select("doc_id", F.md5(enrich.section_prompt("Estructura: ", "text")).alias("prompt_md5"), r["title"].alias("title"),
                                                  F.size(r["paragraphs"]).alias("paragraphs"))


SYS = "Eres un asistente técnico."
SUFFIX = f"CASE WHEN language = 'gl' THEN {lit(chat.LANGUAGE_SUFFIX['gl'])} ELSE {lit(chat.LANGUAGE_SUFFIX['es'])} END"


@register("e08_answer_requests", f"""{BASE}, {topk("score >= 0.3 AND view = 'text' AND query_id % 3 <> 2")}, {fused()}, {final(5)},
ctx AS (SELECT query_id, array_to_string(list({BLOCKS['retriever']} ORDER BY rank), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS context FROM fin JOIN vchunks USING (chunk_id) GROUP BY query_id),
qs AS (SELECT query_id, query, CASE WHEN query_id % 2 = 0 THEN 'gl' ELSE 'es' END AS language FROM vqueries)
SELECT query_id, CASE WHEN context IS NOT NULL THEN {lit(SYS)} || {SUFFIX} ELSE '' END AS system, CASE WHEN context IS NOT NULL THEN {lit(chat.QUESTION_HEAD)} || query || chr(10) || chr(10) || 'FRAGMENTOS:' || chr(10) || context || {lit(chat.QUESTION_TAIL)} ELSE '' END AS user_text,
CASE WHEN context IS NULL THEN {lit(chat.NO_HITS_REPLY)} ELSE '' END AS fixed_reply FROM qs LEFT JOIN ctx USING (query_id)""")
def _(spark, sf):
    c, q = D.vector_chunks(spark, sf), D.benchmark_queries(spark, sf)
    asked = q.select("query_id", F.col("query").alias("question"), F.when(F.col("query_id") % 2 == 0, "gl").otherwise("es").alias("language"),
                     F.array().cast("array<string>").alias("history"))
    found = V.retrieve(q.withColumn("vector", F.when(F.col("query_id") % 3 != 2, F.col("vector"))), c, 5, views={"text": "v_text"})
    hits = P.hits_with_payload(found, c, ["source", "article_no", "header", "text", F.col("ordinance_code").alias("ordinance")])
    r = chat.answer_requests(asked, V.assemble_context(hits, "retriever"), SYS)
    return r.select("query_id", *[F.coalesce(a, F.lit("")).alias(b) for a, b in (("system", "system"), ("user", "user_text"), ("fixed_reply", "fixed_reply"))])


@register("e08_parcel_answer_requests", f"""{D.with_shared('questions', 'parcel_boxes')} SELECT query_id, 'DATOS DE LA PARCELA (Catastro + PXOM):' || chr(10) || '- Referencia catastral : P' || CAST(query_id AS VARCHAR)
|| chr(10) || '- Superficie           : ' || CAST(p_size AS VARCHAR) || ' m²' || chr(10) || '- Vía / Número         : ' || p_name || ' nº ' || chr(10) || '- Zona PXOM            : N/D (ordenanza ' || code || ')'
|| chr(10) || '- Clasificación        : ' || p_brand || chr(10) || chr(10) || {lit(chat.RULE)} || chr(10) || 'NORMATIVA APLICABLE:' || chr(10) || {lit(chat.RULE)} || chr(10) || 'ctx ' || language || chr(10) || chr(10) || {lit(chat.RULE)}
|| chr(10) || 'PREGUNTA DEL ARQUITECTO:' || chr(10) || text || {lit(chat.PARCEL_TAIL)} AS user_text FROM questions JOIN parcel_boxes ON parcel_ref = query_id""")
def _(spark, sf):
    p = D.shared(spark, sf, "parcel_boxes").select(F.col("parcel_ref").alias("query_id"), "p_size", "p_name", "p_brand")
    j = D.shared(spark, sf, "questions").join(p, "query_id")
    parcel = {"ref": F.concat(F.lit("P"), F.col("query_id").cast("string")), "area": F.col("p_size"), "street": F.col("p_name"), "number": F.lit(None),
              "zone": F.lit(""), "ordinance": F.col("code"), "land_class": F.col("p_brand")}
    return j.select("query_id", chat.parcel_question_text(F.col("text"), F.concat(F.lit("ctx "), "language"), parcel).alias("user_text"))


def _wiki_pages(spark, sf):
    none = F.array().cast("array<string>")
    even = F.col("pos") % 2 == 0
    a = _wiki_articles(spark, sf).withColumns({
        "summary": F.concat(F.lit("Resumen "), "number"), "notes": F.when(even, F.array(F.concat(F.lit("nota "), "number"))).otherwise(none), "refs": none,
        "tags": F.when(even, F.array(F.lit("suelo urbano"), F.lit("altura"))).otherwise(none),
        "image_urls": F.when(F.col("pos") % 3 == 0, F.array(F.lit("http://a/1.png"), F.lit(""))).otherwise(none)})
    return a.select("source", "pos", enrich.wiki_page(F.lit("2026-01-01")).alias("page"))


@register("e09_wiki_pages", f"""{MD_ART}, w AS ({KINDED}) SELECT source, pos, '---' || chr(10) || 'articulo: "' || number || '"' || chr(10) || 'titulo: "' || title || '"' || chr(10) || 'tipo_doc: "' || kind || '"' || chr(10) || 'subtipo: "Norma"' || chr(10)
|| 'documento: "' || label || '"' || chr(10) || 'ordenanza: "' || context_code || '"' || chr(10) || 'capitulo: "' || chapter || '"' || chr(10) || 'generado: "2026-01-01"' || chr(10) || 'tags: [' || CASE WHEN pos % 2 = 0 THEN '"suelo urbano", "altura"' ELSE '' END || ']' || chr(10) || '---' || chr(10) || chr(10)
|| '# Norma — Art. ' || number || '. ' || title || chr(10) || chr(10) || '> **Tipo:** `' || kind || '` | **Documento:** Norma | **Capítulo:** ' || chapter || ' | **Ordenanza:** ' || context_code || chr(10) || chr(10) || '## Resumen' || chr(10) || chr(10) || 'Resumen ' || number
|| chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Texto Original' || chr(10) || chr(10) || block || chr(10) || chr(10) || CASE WHEN pos % 3 = 0 THEN '## Imágenes' || chr(10) || chr(10) || '![](http://a/1.png)' || chr(10) || chr(10) ELSE '' END
|| '---' || chr(10) || chr(10) || '## Notas de Interpretación' || chr(10) || chr(10) || CASE WHEN pos % 2 = 0 THEN '- nota ' || number ELSE '_Sin notas._' END || chr(10) || chr(10) || '## Referencias Cruzadas' || chr(10) || chr(10) || '_Sin referencias identificadas._' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
|| CASE WHEN pos % 2 = 0 THEN '#suelo_urbano #altura' ELSE '' END || chr(10) || '*Generado el 2026-01-01 con `offline`*' || chr(10) AS page FROM w""")
def _(spark, sf):
    return _wiki_pages(spark, sf)


@register("k11_page_files", f"SELECT source, CAST(pos AS VARCHAR) || '.md' AS name, md5(page) AS page_md5 FROM ({ORACLES['e09_wiki_pages']})")
def _(spark, sf):
    """Every page as a file of its own, written in two runs of which the second goes on where the first stopped, and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/wiki-{uuid.uuid4().hex}"
    pages = _wiki_pages(spark, sf).select(F.concat("source", F.lit("/"), "pos", F.lit(".md")).alias("path"), F.col("page").alias("content"), "pos")
    files.write_pages(pages.filter("pos % 2 = 0"), path)
    files.write_pages(pages, path, header={"source": "articles"})
    return spark.read.format("document_folder").load(path).select("source", "name", F.md5("text").alias("page_md5"))


@register("s01_document_folder", """SELECT coalesce(nullif(source, ''), 'none') AS source, doc_id || '.txt' AS name, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, md5(coalesce(text, '')) AS text_md5 FROM documents""")
def _(spark, sf):
    """The documents as text files by source, read as a folder."""
    path = f"{ensure_checkpoint_dir(spark)}/folder-{uuid.uuid4().hex}"
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("none"))
    files.write_pages(D.table(spark, sf, "documents").select(F.concat(source, F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")), path, resume=False)
    return spark.read.format("document_folder").option("suffix", ".txt").load(path).select("source", "name", "size", F.md5("text").alias("text_md5"))


@register("w09_numeric_order", f"{REFS} SELECT ref_number, dense_rank() OVER (ORDER BY CAST(regexp_extract(ref_number, '^(\\d+)', 1) AS INT), TRY_CAST(regexp_extract(ref_number, '\\.(\\d+)$', 1) AS INT) NULLS FIRST) AS place FROM (SELECT DISTINCT ref_number FROM refs)")
def _(spark, sf):
    # places come from counting smaller distinct sort keys per whole part, so no single global window is needed
    d = cut_lineage(_refs(spark, sf).select("ref_number").distinct())  # written once: the places read it three times
    whole, part = number_parts("ref_number")
    d = d.select("ref_number", whole.alias("w"), F.coalesce(part, F.lit(-1)).alias("p"))
    from pyspark.sql import Window

    per = d.groupBy("w").agg(F.count("*").alias("n"))
    before = per.withColumn("_all", F.lit(1))
    from regspark.operators.ordered import running_sum

    offset = running_sum(before, ["_all"], "w", F.col("n"), "upto").select("w", (F.col("upto") - F.col("n")).alias("off"))
    inner = F.row_number().over(Window.partitionBy("w").orderBy("p"))
    return d.withColumn("r", inner).join(offset, "w").select("ref_number", (F.col("off") + F.col("r")).alias("place"))
