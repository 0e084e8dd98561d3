"""State, storage, chat and incremental queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from regspark.session import ensure_checkpoint_dir
from regspark.functions import text as C
from regspark.operators import chat, enrich
from regspark.operators import retrieve as V
from regspark.operators import segment as S
from regspark.operators import state as ST
from regspark.plans import derive as D
from regspark.plans.catalog import ORACLES, register
from regspark.plans.catalog_retrieve import BASE, ERR, WAIT, final, fused, topk
from regspark.plans.catalog_segment import MD_ART, _md
from regspark.sources import sinks
from regspark.sources.keyed import KeyedStore

STATE = f"""{D.with_shared('state_log', 'state_chunks')},
state AS (SELECT * FROM state_log QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ts DESC, seq DESC) = 1)"""


def _state(spark, sf):
    return ST.latest_state(D.shared(spark, sf, "state_log"), tie="seq")


def _chunks(spark, sf):
    return D.shared(spark, sf, "state_chunks")


@register("m05_latest_state", f"{STATE} SELECT chunk_id, seq, event_type, indexed, summary FROM state")
def _(spark, sf):
    return _state(spark, sf).select("chunk_id", "seq", "event_type", "indexed", "summary")


@register("j01_stored_enrichment", f"{STATE} SELECT c.chunk_id, source, text, coalesce(s.summary, c.summary) AS summary FROM state_chunks c LEFT JOIN state s USING (chunk_id)")
def _(spark, sf):
    return ST.apply_enrichment(_chunks(spark, sf), _state(spark, sf), ["summary"])


@register("j02_to_enrich", f"{STATE} SELECT chunk_id, source FROM state_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM state)")
def _(spark, sf):
    return ST.to_enrich(_chunks(spark, sf), _state(spark, sf)).select("chunk_id", "source")


@register("j03_to_index", f"{STATE} SELECT chunk_id, source FROM state_chunks WHERE chunk_id IN (SELECT chunk_id FROM state WHERE NOT indexed)")
def _(spark, sf):
    return ST.to_index(_chunks(spark, sf), _state(spark, sf)).select("chunk_id", "source")


@register("a15_ingest_progress", f"""{STATE} SELECT source, count(*) AS chunks, count(indexed) AS enriched, count(*) FILTER (indexed) AS indexed, count(*) FILTER (NOT indexed) AS to_index,
count(*) FILTER (indexed IS NULL) AS to_enrich FROM state_chunks c LEFT JOIN state s USING (chunk_id) GROUP BY source""")
def _(spark, sf):
    return ST.progress(_chunks(spark, sf), _state(spark, sf))


@register("m03_completion_under_errors", f"""WITH x AS (SELECT user_id % 13 AS source, {ERR.format(S='VARCHAR')} AS e FROM events), y AS (SELECT source, CASE WHEN e IS NULL THEN 'ok' WHEN {WAIT} > 300 THEN 'quota' WHEN {WAIT} IS NOT NULL THEN 'retry' ELSE 'empty' END AS status FROM x)
SELECT source, count(*) AS chunks, count(*) FILTER (status IN ('ok', 'empty')) AS finished, count(*) FILTER (status IN ('quota', 'retry')) AS pending FROM y GROUP BY source""")
def _(spark, sf):
    x = D.table(spark, sf, "events").select((F.col("user_id") % 13).alias("source"), F.expr(ERR.format(S="STRING")).alias("error"))
    return ST.completion(x.select("source", F.coalesce(enrich.error_status("error"), F.lit("ok")).alias("status")))


@register("k04_upsert", f"""{D.with_shared('state_log', 'state_chunks')}, fresh AS (SELECT chunk_id, event_type AS source, summary AS text, seq FROM state_log QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) = 1)
SELECT chunk_id, source, text, CAST(-1 AS BIGINT) AS seq FROM state_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh) UNION ALL SELECT * FROM fresh""")
def _(spark, sf):
    old = _chunks(spark, sf).select("chunk_id", "source", "text", F.lit(-1).cast("long").alias("seq"))
    new = D.shared(spark, sf, "state_log").select("chunk_id", F.col("event_type").alias("source"), F.col("summary").alias("text"), "seq")
    return ST.upsert(old, new, "chunk_id", ["seq"])


def _stored(spark, sf):
    """The old rows, and the log merged in two batches, in a keyed store; chunks move between sources."""
    store = KeyedStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", "chunk_id string, source string, text string, seq long", version=("seq",))
    store.merge(_chunks(spark, sf).select("chunk_id", "source", "text", F.lit(-1).cast("long").alias("seq")))
    new = D.shared(spark, sf, "state_log").select("chunk_id", F.col("event_type").alias("source"), F.col("summary").alias("text"), "seq")
    late = F.col("seq") % 2 == 0
    store.merge(new.filter(~late))
    store.merge(new.filter(late))
    return store


@register("k04_store_upsert", ORACLES["k04_upsert"])
def _(spark, sf):
    return _stored(spark, sf).read()


@register("k04_store_look_up", f"""{D.with_shared('state_log', 'state_chunks')}, fresh AS (SELECT chunk_id, event_type AS source, summary AS text, seq FROM state_log QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) = 1),
asked AS (SELECT chunk_id FROM state_log WHERE event_type = 'purchase' AND seq % 10 = 0)
SELECT * FROM (SELECT chunk_id, source, text, CAST(-1 AS BIGINT) AS seq FROM state_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh) UNION ALL SELECT * FROM fresh) WHERE chunk_id IN (SELECT chunk_id FROM asked)""")
def _(spark, sf):
    return _stored(spark, sf).read(D.shared(spark, sf, "state_log").filter("event_type = 'purchase' and seq % 10 = 0"))


@register("k05_copy_check", "SELECT 'orders' AS collection, count(*) AS \"rows\", true AS same FROM orders")
def _(spark, sf):
    o = D.table(spark, sf, "orders")
    copy = f"{ensure_checkpoint_dir(spark)}/copy-{uuid.uuid4().hex}"
    o.select(*reversed(o.columns)).write.parquet(copy)
    a, b = ST.fingerprint(o, "orders"), ST.fingerprint(spark.read.parquet(copy), "orders")
    return a.join(b.select("collection", F.col("rows").alias("r"), F.col("hash").alias("h")), "collection").select(
        "collection", "rows", ((F.col("rows") == F.col("r")) & (F.col("hash") == F.col("h"))).alias("same"))


@register("k06_totals", " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS \"rows\" FROM {t}" for t in D.TABLES))
def _(spark, sf):
    return ST.totals({t: D.table(spark, sf, t) for t in D.TABLES})


@register("k07_zone_split", f"""{D.with_shared('zone_boxes')} SELECT zone_id, CASE WHEN zone_id % 6 = 5 THEN 'code' WHEN zone_id % 4 = 3 THEN 'geometry' ELSE 'stored' END AS outcome FROM zone_boxes""")
def _(spark, sf):
    z = D.zones(spark, sf)
    z = z.select("zone_id", F.when(F.col("zone_id") % 6 != 5, F.col("ordinance")).alias("code"),
                 F.when(F.col("zone_id") % 4 != 3, F.col("rings")).when(F.col("zone_id") % 8 == 3, F.slice("rings", 1, 0)).alias("rings"))
    good, bad = sinks.split_zones(z)
    return good.select("zone_id", F.lit("stored").alias("outcome")).unionByName(bad.select("zone_id", F.col("reason").alias("outcome")))


NEW_PARAMS = """SELECT 'U' || CAST(n_nationkey % 9 + 1 AS {S}) || '.' || CAST(n_nationkey % 3 + 1 AS {S}) AS ordinance, max(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END) AS max_height, min(n_regionkey) AS buildability
FROM {nation} GROUP BY 'U' || CAST(n_nationkey % 9 + 1 AS {S}) || '.' || CAST(n_nationkey % 3 + 1 AS {S})"""


@register("k08_j11_zone_parameters", f"""{D.with_shared('zone_boxes')}, u AS ({NEW_PARAMS.format(S='VARCHAR', nation='nation')})
SELECT zone_id, z.ordinance, CASE WHEN u.ordinance IS NULL THEN -1 ELSE u.max_height END AS max_height, CASE WHEN u.ordinance IS NULL THEN -2 ELSE u.buildability END AS buildability FROM zone_boxes z LEFT JOIN u ON u.ordinance = z.ordinance""")
def _(spark, sf):
    u = spark.sql(NEW_PARAMS.replace("{S}", "STRING"), nation=D.table(spark, sf, "nation"))
    z = D.shared(spark, sf, "zone_boxes").select("zone_id", "ordinance", F.lit(-1).alias("max_height"), F.lit(-2).alias("buildability"))
    return ST.update_where(z, u, "ordinance", ["max_height", "buildability"])


@register("k09_annotations", "SELECT doc_id, lang AS \"user\", source AS article_ref FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 7 <> 3 AND lang <> '' AND source <> '' AND text <> ''")
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 3, F.col("lang")).alias("user"),
                                               F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("article_ref"), "text")
    return sinks.valid_annotations(d).select("doc_id", "user", "article_ref")


@register("k10_cache_aside", """WITH req AS (SELECT o_orderkey AS req_id, 'K' || o_custkey AS key FROM orders), cache AS (SELECT CASE WHEN c_custkey % 3 <> 0 THEN 'K' ELSE 'old' END || c_custkey AS key, c_name AS value FROM customer)
SELECT req_id, req.key, coalesce(value, 'computed ' || req.key) AS value FROM req LEFT JOIN cache USING (key)""")
def _(spark, sf):
    req = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("req_id"), F.concat(F.lit("K"), "o_custkey").alias("key"))
    cache = D.table(spark, sf, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 != 0, "K").otherwise("old"), "c_custkey").alias("key"), F.col("c_name").alias("value"))
    out, _added = ST.cache_aside(req, cache, "key", lambda miss: miss.withColumn("value", F.concat(F.lit("computed "), "key")))
    return out.select("req_id", "key", "value")


@register("k10_stored_cache", ORACLES["k10_cache_aside"])
def _(spark, sf):
    """Three runs against one store: it is filled, half of the requests are answered, then all; each key is computed once."""
    req = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("req_id"), F.concat(F.lit("K"), "o_custkey").alias("key"))
    cache = D.table(spark, sf, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 != 0, "K").otherwise("old"), "c_custkey").alias("key"), F.col("c_name").alias("value"))
    store = KeyedStore(spark, f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}", "key string, value string", key="key")
    store.merge(cache)
    compute = lambda miss: miss.withColumn("value", F.concat(F.lit("computed "), "key"))
    ST.stored_answers(req.filter("req_id % 2 = 0"), store, compute)
    return ST.stored_answers(req, store, compute).select("req_id", "key", "value")


@register("k11_m04_pending_pages", f"{MD_ART} SELECT source, pos, number FROM art WHERE NOT (length(source) % 2 = 0 AND CAST(regexp_extract(number, '^(\\d+)', 1) AS INT) % 3 = 0)")
def _(spark, sf):
    pages = _md(spark, sf).select("source", "pos", "number")
    whole = F.regexp_extract("number", r"^(\d+)", 1).cast("int")
    return sinks.pending_pages(pages, pages.filter((F.length("source") % 2 == 0) & (whole % 3 == 0)).select("source", "number").distinct())


@register("w05_point_ids", "SELECT o_orderkey, (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY o_orderkey) - 1 AS point_id FROM orders")
def _(spark, sf):
    have = D.table(spark, sf, "customer").agg(F.count("*").alias("next_id"))
    return ST.point_ids(have, D.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@register("w05_sparse_point_ids", "SELECT o_orderkey * 1000000007 AS sparse_key, (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY o_orderkey) - 1 AS point_id FROM orders")
def _(spark, sf):
    have = D.table(spark, sf, "customer").agg(F.count("*").alias("next_id"))
    return ST.point_ids(have, D.table(spark, sf, "orders").select((F.col("o_orderkey").cast("long") * 1000000007).alias("sparse_key")), "sparse_key")


@register("s13_collection_page", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND doc_id > 100 ORDER BY doc_id LIMIT 50")
def _(spark, sf):
    return ST.scroll(D.table(spark, sf, "documents"), "doc_id", 100, 50, F.col("lang") == "en", ["doc_id", "source", "n_chars"])


@register("a17_run_summary", "SELECT CASE o_orderstatus WHEN 'F' THEN 'sin_chunks' WHEN 'P' THEN 'json_error' ELSE 'ok' END AS outcome, count(*) AS n FROM orders GROUP BY outcome")
def _(spark, sf):
    status = F.col("o_orderstatus")
    r = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), F.when(status == "F", "sin_chunks").when(status == "P", "json_error").alias("reason"))
    return ST.run_summary(r)


# ------------------------------------------------------------------ images and pages


@register("j05_without_decorative_images", f"{D.with_shared('image_map')} SELECT * FROM image_map WHERE NOT (length(source) % 2 = 0 AND img_key IN ('IMAGEN_1', 'IMAGEN_2'))")
def _(spark, sf):
    m = D.shared(spark, sf, "image_map")
    keys = F.explode(F.array(F.lit("IMAGEN_1"), F.lit("IMAGEN_2"))).alias("img_key")
    listed = m.filter(F.length("source") % 2 == 0).select("source").distinct().select("source", keys)
    return S.drop_decorative(m, listed)


@register("j08_hits_with_wiki_pages", f"""{BASE}, {topk()}, {fused()}, {final(5)}, h AS (SELECT query_id, rank, chunk_id, 'wiki/' || source || '/art-' || article_no || '.md' AS wiki_path FROM fin JOIN vchunks USING (chunk_id)),
pg AS (SELECT wiki_path, min(vec_id) AS v FROM (SELECT CASE WHEN vec_id % 2 = 0 THEN 'wiki/' ELSE 'old/' END || source || '/art-' || article_no || '.md' AS wiki_path, vec_id FROM vchunks) GROUP BY wiki_path)
SELECT query_id, rank, chunk_id, wiki_path, 'page ' || v AS body FROM h LEFT JOIN pg USING (wiki_path)""")
def _(spark, sf):
    c = D.vector_chunks(spark, sf)
    found = V.retrieve(D.benchmark_queries(spark, sf), c, 5).join(c.select("chunk_id", "source", "article_no"), "chunk_id")
    path = C.wiki_path("source", "article_no")
    pages = c.groupBy(F.when(F.col("vec_id") % 2 == 0, path).otherwise(F.regexp_replace(path, "^wiki", "old")).alias("wiki_path")).agg(F.concat(F.lit("page "), F.min("vec_id")).alias("body"))
    return V.attach_wiki(found, pages).select("query_id", "rank", "chunk_id", "wiki_path", "body")


# ------------------------------------------------------------------ chats


CHAT = D.with_shared("chat")
HIST = "array_to_string(list_transform(list(role || ':' || text) OVER (PARTITION BY {keys} ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), lambda x: x), '|')"


def _shown(df, *cols):
    return df.select(*cols, F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), h["text"])), "|").alias("history"))


@register("w01_history", f"{CHAT} SELECT conv_id, turn, coalesce({HIST.format(keys='conv_id')}, '') AS history FROM chat")
def _(spark, sf):
    return _shown(chat.history(D.shared(spark, sf, "chat")), "conv_id", "turn")


SESSIONS = f"""{CHAT}, ch AS (SELECT *, lag(rc) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM chat),
se AS (SELECT *, CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> rc THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS session FROM ch)"""


@register("w02_sessions", f"{SESSIONS} SELECT conv_id, turn, rc, session FROM se")
def _(spark, sf):
    return chat.sessions(D.shared(spark, sf, "chat")).select("conv_id", "turn", "rc", "session")


@register("w02_session_history", f"{SESSIONS} SELECT conv_id, session, turn, coalesce({HIST.format(keys='conv_id, session')}, '') AS history FROM se")
def _(spark, sf):
    return _shown(chat.session_history(D.shared(spark, sf, "chat")), "conv_id", "session", "turn")


@register("w08_first_and_last_of_group", """SELECT user_id, first(event_id ORDER BY ts, event_id) AS first_event, last(event_id ORDER BY ts, event_id) AS last_event FROM events GROUP BY user_id""")
def _(spark, sf):
    from regspark.operators.ordered import first_by, last_by

    e = D.table(spark, sf, "events").select("user_id", "event_id", "ts")
    a = first_by(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_event"))
    return a.join(last_by(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("last_event")), "user_id")
