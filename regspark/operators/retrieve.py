"""Batch retrieval: N queries against M chunks with several vectors per chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.functions import features as FE
from regspark.functions import fixed as X
from regspark.functions import text as C
from regspark.operators.ordered import first_by, top_per_key
from regspark.session import cut_lineage

VIEWS = {"text": "v_text", "summary": "v_summary", "questions": "v_questions"}
QUERY_BYTES = 64 << 20  # largest query block that is sent to every task
SIMILARITY_BYTES = 64 << 20  # largest block of similarities in one step


def unit(c: Column | str) -> Column:
    """Vector of length one (zero vectors stay as they are), in double precision."""
    v = C._col(c).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


# ------------------------------------------------------------------ similarity kernel


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a list column and the positions of the rows that hold a vector."""
    valid = np.nonzero(column.is_valid().to_numpy(zero_copy_only=False))[0]
    sizes = set(column.drop_null().value_lengths().unique().to_pylist()) - {dim}
    if sizes:
        raise ValueError(f"vectors of {dim} and of {min(sizes)} numbers")
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(-1, dim)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm), valid


class _TopK:
    """The best ``k`` (score, id) pairs per query seen so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int, floor: float | None):
        self.k, self.floor = k, -np.inf if floor is None else floor
        self.scores: list[np.ndarray] = [np.empty(0)] * n
        self.ids: list[np.ndarray | None] = [None] * n

    def add(self, sims: np.ndarray, ids: np.ndarray) -> None:
        bars = np.array([max(self.floor, s[-1]) if len(s) == self.k else self.floor for s in self.scores])
        for q in np.flatnonzero(((sims >= bars[:, None]) & np.isfinite(sims)).any(axis=1)):  # queries that a row can enter
            row, held = sims[q], self.scores[q]
            bar = max(self.floor, held[-1]) if len(held) == self.k else self.floor
            idx = np.nonzero((row >= bar) & np.isfinite(row))[0]
            if len(idx) == 0:
                continue
            if len(idx) > self.k:
                kth = np.partition(row[idx], len(idx) - self.k)[len(idx) - self.k]
                idx = idx[row[idx] >= kth]
            s, i = row[idx], ids[idx]
            if self.ids[q] is not None:
                s, i = np.concatenate([held, s]), np.concatenate([self.ids[q], i])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for q, ids in enumerate(self.ids):
            if ids is not None:
                yield q, self.scores[q], ids


def _search(batches: Iterator[pa.RecordBatch], qids: list, qmat: np.ndarray, qmatch: np.ndarray | None, id_col: str,
            views: dict[str, str], match_col: str | None, k: int, floor: float | None) -> list[tuple]:
    tops = {v: _TopK(len(qids), k, floor) for v in views}
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False)
        if ids.dtype == object:
            ids = ids.astype(str)
        allowed = None
        if match_col is not None:
            values = batch.column(batch.schema.get_field_index(match_col)).to_numpy(zero_copy_only=False)
            allowed = pd.isna(qmatch)[:, None] | (qmatch[:, None] == values[None, :])
        for view, col in views.items():
            mat, valid = _matrix(batch.column(batch.schema.get_field_index(col)), qmat.shape[1])
            if len(valid) == 0:
                continue
            step = max(1, SIMILARITY_BYTES // (8 * max(1, len(qids))))
            for at in range(0, len(valid), step):
                rows = valid[at:at + step]
                sims = np.round(qmat @ mat[at:at + step].T, 9)
                if allowed is not None:
                    sims = np.where(allowed[:, rows], sims, -np.inf)
                tops[view].add(sims, ids[rows])
    return [(qids[q], view, i, float(s)) for view, top in tops.items() for q, ss, ii in top.rows() for s, i in zip(ss, ii)]


def similarity_hits(queries: DataFrame, chunks: DataFrame, k: int = X.TOP_K_VIEW, floor: float | None = X.SCORE_FLOOR,
                    views: dict[str, str] | None = None, id_col: str = "chunk_id",
                    match: tuple[str, str] | None = None, max_query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact cosine top-k per query and view. Columns query_id, view, rank, ``id_col``, score.

    ``queries``: query_id, vector; ``match=(query column, chunk column)`` restricts a query to chunks with an
    equal value (NULL on the query side: no restriction). Every task keeps at most k rows per query and view,
    so only those are shuffled. A query block below ``max_query_bytes`` is sent to all tasks; larger query
    sets are tiled against blocks of chunks. Queries and chunks without a vector have no hits; vectors of different
    lengths are an error.
    """
    views = views or VIEWS
    queries = queries.filter("vector is not null")
    qcols = ["query_id", "vector"] + ([match[0]] if match else [])
    ccols = list(dict.fromkeys([id_col, *views.values()] + ([match[1]] if match else [])))
    queries = cut_lineage(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *qcols[2:]))  # evaluated once
    dim_row = queries.select(F.size("vector").alias("d")).first()
    dim = dim_row["d"] if dim_row else 1
    cap = max(1, max_query_bytes // (8 * dim))
    block = queries.limit(cap + 1).toArrow()
    id_type = chunks.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("view", T.StringType()),
                           T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema]
    data = chunks.select(*ccols)
    if block.num_rows <= cap:
        flat = block.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if len(flat) != block.num_rows * dim:
            raise ValueError("vectors of different lengths")
        shared = data.sparkSession.sparkContext.broadcast(
            (block.column("query_id").to_pylist(), flat.reshape(-1, dim), block.column(match[0]).to_pylist() if match else None))
        arrow = pa.schema([("query_id", _arrow(schema[0].dataType)), ("view", pa.string()),
                           (id_col, _arrow(id_type)), ("score", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, vectors, wanted = shared.value
            if not qids:
                return
            qmat = vectors / np.where((norm := np.linalg.norm(vectors, axis=1, keepdims=True)) == 0, 1, norm)
            rows = _search(batches, qids, qmat, np.array(wanted, dtype=object) if match else None, id_col, views,
                           match[1] if match else None, k, floor)
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array([_plain(v) for v in c], t) for c, t in zip(cols, arrow.types)], schema=arrow)

        hits = data.mapInArrow(run, schema)
    else:
        hits = _tiled_hits(queries, data, schema, names, cap, dim, k, floor, views, id_col, match)
    return top_per_key(hits, ["query_id", "view"], [F.desc("score"), F.asc(id_col)], k)


def _tiled_hits(queries: DataFrame, chunks: DataFrame, schema: T.StructType, names: list[str], cap: int, dim: int, k: int,
                floor: float | None, views: dict[str, str], id_col: str, match: tuple[str, str] | None) -> DataFrame:
    """Block nested loop: every (query block, chunk block) pair is one group of bounded bytes."""
    chunk_rows = max(256, 2 * cap // len(views))
    qb = -(-queries.count() * 2 // cap)
    cb = max(1, -(-chunks.count() // chunk_rows))
    q = queries.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int")) \
        .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))))
    c = chunks.withColumn("_cb", F.pmod(F.xxhash64(id_col), F.lit(cb)).cast("int")) \
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        qids = left.column("query_id").to_pylist()
        arrow = pa.schema([("query_id", _arrow(schema[0].dataType)), ("view", pa.string()),
                           (id_col, _arrow(schema[2].dataType)), ("score", pa.float64())])
        rows: list[tuple] = []
        if qids and right.num_rows:
            qmat, _ = _matrix(left.column("vector").combine_chunks(), dim)
            wanted = np.array(left.column(match[0]).to_pylist(), dtype=object) if match else None
            rows = _search(iter(right.combine_chunks().to_batches(max_chunksize=4096)), qids, qmat, wanted, id_col, views,
                           match[1] if match else None, k, floor)
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.Table.from_arrays([pa.array([_plain(v) for v in col], t) for col, t in zip(cols, arrow.types)], schema=arrow)

    return q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb")).applyInArrow(tile, schema)


def _plain(v):
    return v.item() if isinstance(v, np.generic) else v


def _arrow(t: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t.simpleString()]


# ------------------------------------------------------------------ filters


def payload_filter(spec: dict[str, object] | None, compat: bool = False) -> Column:
    """V3: AND of equalities; ``source_prefix`` selects a family of sources (``compat``: the fixed code list)."""
    cond = F.lit(True)
    for field, value in (spec or {}).items():
        if field == "source_prefix":
            cond &= F.col("source").isin(X.CODE_SOURCES) if compat else F.col("source").startswith(str(value))
        elif field == "ordinance_code":
            cond &= F.col(field) == X.ORDINANCE_ALIASES.get(value, value)
        else:
            cond &= F.col(field) == F.lit(value)
    return cond


def must_should(must: dict[str, object], should: list[str]) -> Column:
    """V4: all equalities and at least one of the boolean columns."""
    cond = payload_filter(must)
    any_of = F.lit(False)
    for field in should:
        any_of |= F.col(field)
    return cond & any_of


def in_collections(collections: dict[str, DataFrame], wanted: list[str]) -> tuple[DataFrame | None, list[str]]:
    """V5: the wanted collections as one table with a collection column, and the unknown names."""
    known = [n for n in wanted if n in collections]
    out = None
    for name in known:
        part = collections[name].withColumn("collection", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, [n for n in wanted if n not in collections]


# ------------------------------------------------------------------ fusion and ranking


def rank_fusion(hits: DataFrame, id_col: str = "chunk_id", k: int = X.RRF_K) -> DataFrame:
    """V6: sum of 1/(k + rank) over the lists of a query; ties go to the smaller id."""
    fused = hits.groupBy("query_id", id_col).agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("rrf_score"))
    return fused


def ranked(fused: DataFrame, score: str, k: int, id_col: str = "chunk_id") -> DataFrame:
    """The final ``k`` per query by score."""
    return top_per_key(fused, ["query_id"], [F.desc(score), F.asc(id_col)], k)


def rerank(fused: DataFrame, k: int, scorer=None, query_text: str = "query", text: str = "text_with_header",
           min_score: float | None = None, id_col: str = "chunk_id") -> DataFrame:
    """V7, V8: without a scorer the fusion score is copied; with one, (query, text after the first blank line)
    pairs are scored. ``min_score`` is applied only when a scorer ran."""
    if scorer is None:
        return ranked(fused.withColumn("rerank_score", F.col("rrf_score")), "rerank_score", k, id_col)
    body = F.when(F.col(text).contains("\n\n"), F.expr(f"substr({text}, locate('\\n\\n', {text}) + 2)")).otherwise(F.col(text))
    scored = fused.withColumn("rerank_score", scorer(FE.rerank_query(query_text), body).cast("double"))
    out = ranked(scored, "rerank_score", k, id_col)
    return out if min_score is None else out.filter(F.col("rerank_score") >= min_score)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = X.TOP_K_FINAL, where: Column | None = None, **search) -> DataFrame:
    """V1 + V6 + V7: top-k chunk ids per query over the three views; the filter reaches the scan."""
    data = chunks if where is None else chunks.filter(where)
    return rerank(rank_fusion(similarity_hits(queries, data, **search)), k)


def with_fallback(queries: DataFrame, chunks: DataFrame, k: int = X.TOP_K_SERVICE, code: str = "ordinance_code",
                  chunk_code: str = "ordinance_code", fallback_vector: str | None = None) -> DataFrame:
    """Hits filtered by the zone of each query; queries without any get unfiltered hits of the plain question.

    Both passes share one scan of the chunks: a query is searched twice, with and without its filter.
    """
    alt = fallback_vector or "vector"
    wanted = F.when(F.coalesce(F.col(code), F.lit("")) == "", F.lit(None)).otherwise(FE.alias_ordinance(code))
    key = F.col("query_id").cast("string")
    both = queries.select(F.concat(F.lit("f:"), key).alias("query_id"), "vector", wanted.alias("_code")).unionByName(
        queries.select(F.concat(F.lit("u:"), key).alias("query_id"), F.col(alt).alias("vector"),
                       F.lit(None).cast("string").alias("_code")))
    out = rerank(rank_fusion(similarity_hits(both, chunks, match=("_code", chunk_code))), k)
    out = out.withColumn("used_fallback", F.col("query_id").startswith("u:")) \
        .withColumn("query_id", F.substring("query_id", 3, 1 << 30).cast(queries.schema["query_id"].dataType))
    # at most 2k rows per query: one bounded window instead of a second search
    any_filtered = F.bool_or(~F.col("used_fallback")).over(Window.partitionBy("query_id"))
    return out.withColumn("_f", any_filtered).filter(~F.col("used_fallback") | ~F.col("_f")).drop("_f")


def ordinance_context(codes: DataFrame, chunks: DataFrame, direct_k: int = 8, semantic_k: int = 6) -> DataFrame:
    """V9: per code up to 8 chunks that define a parameter; codes without any get the 6 nearest urban chunks.

    ``codes``: code, vector.
    """
    flags = ["defines_buildability", "defines_height", "defines_occupation", "defines_setbacks"]
    eligible = chunks.filter(must_should({}, flags)).select(F.col("ordinance_code").alias("code"), "chunk_id")
    direct = top_per_key(eligible, ["code"], [F.asc("chunk_id")], direct_k) \
        .join(codes.select("code"), "code", "left_semi").select("code", "rank", "chunk_id", F.lit("filter").alias("path"))
    hits = similarity_hits(codes.select(F.col("code").alias("query_id"), "vector"), chunks.filter(F.col("scope") == "urbano"),
                           semantic_k, None, {"text": "v_text"})
    semantic = hits.select(F.col("query_id").alias("code"), "rank", "chunk_id", F.lit("semantic").alias("path")) \
        .join(direct.select("code").distinct(), "code", "left_anti")
    return direct.unionByName(semantic)


# ------------------------------------------------------------------ presentation


def context_block(style: str) -> Column:
    """One numbered block; columns rank, source, article_no, ordinance, header, text and, for the
    service style, norm_title, chapter, section, tables."""
    n = F.col("rank").cast("string")

    def opt(prefix: str, col: str) -> Column:
        return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(prefix), F.col(col))).otherwise(F.lit(""))

    if style == "retriever":
        return F.concat(F.lit("[Fuente "), n, F.lit(" - "), "source", F.lit("] Artículo "), "article_no", F.lit(" - "),
                        "ordinance", F.lit("\n"), "header", F.lit("\n"), "text")
    if style == "service":
        return F.concat(F.lit("### [Fuente "), n, F.lit("] "), "source", F.lit(" | Art. "), "article_no",
                        opt(" | Ordenanza: ", "ordinance"), opt("\nNormativa: ", "norm_title"), opt("\nCapítulo: ", "chapter"),
                        opt(" | Sección: ", "section"), opt("\nTítulo: ", "header"), F.lit("\n\n"), "text",
                        opt("\n\n[Tabla asociada]:\n", "tables"))
    return F.concat(F.lit("Fragmento "), n, F.lit(" - Art. "), "article_no", F.lit("\n"),
                    F.when(F.col("ordinance") != "", F.concat(F.lit("Ordenanza: "), "ordinance", F.lit("\n"))).otherwise(F.lit("")),
                    "header", F.lit("\n"), "text", F.lit("\n\n"))


def assemble_context(hits: DataFrame, style: str = "service") -> DataFrame:
    """The context text of each query; the top-k bounds every group."""
    sep = "" if style == "basic" else X.BLOCK_SEPARATOR
    blocks = hits.select("query_id", "rank", context_block(style).alias("block"))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), sep).alias("context"))


def attach_wiki(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """The wiki page of each hit by its path, NULL when there is none. ``pages``: wiki_path, body."""
    keyed = hits.withColumn("wiki_path", C.wiki_path("source", "article_no"))
    return keyed.join(pages.select("wiki_path", "body"), ["wiki_path"], "left")


def article_card() -> Column:
    """Card text from number, heading, title/chapter/section structs, body, paragraphs struct and refs array."""
    def level(label: str, col: str) -> Column:
        return F.when(F.col(col).isNotNull(), F.concat(F.lit(f"- {label} "), F.col(col)["number"], F.lit(": "),
                                                       F.col(col)["name"], F.lit("\n"))).otherwise(F.lit(""))

    items = F.array_join(F.transform(F.col("structure.paragraphs"), lambda p: F.concat(
        F.lit("**"), p["number"], F.lit(".** "), p["text"], F.lit("\n\n"))), "")
    body = F.when(F.col("structure.kind") == "numbered", items).otherwise(F.concat("body", F.lit("\n\n")))
    cited = F.array_join(F.transform(F.slice("refs", 1, 10), lambda r: F.concat(F.lit("Art. "), r["number"])), ", ")
    return F.concat(
        F.lit("## Articulo "), "number", F.lit(": "), "heading", F.lit("\n\n**Contexto:**\n"),
        level("Titulo", "title"), level("Capitulo", "chapter"), level("Seccion", "section"), F.lit("\n**Contenido:**\n\n"), body,
        F.when(F.size("refs") > 0, F.concat(F.lit("**Referencias:**\n"), cited, F.lit("\n"))).otherwise(F.lit("")))


def keyword_search(df: DataFrame, term: str, title: str | None = None, body: str | None = None, width: int = 160) -> DataFrame:
    """Rows whose title and/or body contains a term, with hit count and the text around the first hit."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (title, body) if c]
    needle = term.lower()
    hits = sum((F.size(F.split(c, r"\Q" + needle + r"\E", -1)) - 1 for c in low), F.lit(0))
    shown = F.coalesce(F.col(body or title), F.lit(""))
    at = F.locate(needle, F.lower(shown))
    start = F.greatest(at - width // 2, F.lit(1))
    around = F.when(at > 0, shown.substr(start, F.lit(width))).otherwise(F.lit(""))
    return df.withColumns({"hits": hits.cast("long"), "around": around}).filter("hits > 0")


def locate_article(pages: DataFrame, numbers: DataFrame, first_page: int = 7, width: int = 600, min_chars: int = 100) -> DataFrame:
    """First page that holds ``Art. N.``, ``Art.N.`` or ``Art N.``, with the text from there, the length
    up to the next article and whether it passes the length rule. ``pages``: doc, page, text. ``numbers``: doc, number.

    The spelled numbers are extracted once per page and joined, instead of testing every number on every page.
    """
    found = pages.filter(F.col("page") >= first_page).select(
        "doc", "page", "text", F.explode(F.array_distinct(C.matches(F.col("text"), r"Art(?:\. ?| )(\d+)\.", 1))).alias("number"))
    best = first_by(found.join(numbers, ["doc", "number"], "left_semi"), ["doc", "number"], ["page"])
    tries = [F.expr(f"locate(concat('{p}', number, '.'), text)") for p in ("Art. ", "Art.", "Art ")]
    at = F.coalesce(*[F.nullif(t, F.lit(0)) for t in tries])
    rest = F.expr("substr(text, at + 20)")
    nxt = F.regexp_instr(rest, F.lit(r"Art\.\s+\d+\."))
    out = best.withColumn("at", at).withColumn("context", F.expr(f"substr(text, at, {width})"))
    out = out.withColumn("body_chars", F.when(nxt > 0, nxt - 1 + 20).otherwise(F.length("context")).cast("long"))
    return out.select("doc", "number", "page", "at", "context", "body_chars", (F.col("body_chars") > min_chars).alias("long_enough"))
