"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import documents, new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads them back."""
    from regspark.llm.token_files import read_token_files, write_token_files

    folder = new_folder(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder, with_ids=False)


@query
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from regspark.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=3, max_bits=2).select("doc_id", "fingerprint", "component_id")


@query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every whole text, verified, and whether they decode to the text again."""
    from regspark.llm.piece_codec import encode

    rows = encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("piece_bpe_32k.model"), round_trip_col="round_trip")
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


@query
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 40 shards whose row counts are at most one apart."""
    from regspark.llm.sharding import deal, row_size

    dealt = deal(documents(spark, sf_dir), shards=40, seed=7)
    return dealt.select("doc_id", row_size().alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
                        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics, base rules and the classifier's verdict for every document."""
    from regspark.llm.quality import judged

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = judged(documents(spark, sf_dir), labels)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the repeated line runs of 50 words or more that an earlier document has."""
    from regspark.llm.line_dedup import deduplicated

    return deduplicated(documents(spark, sf_dir), min_words=50).select("doc_id", "n_lines", "n_deleted", "text")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the best matching benchmark item for every document."""
    from regspark.llm.decontaminate import contamination

    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("_k1", "_k2")


OP9_SQL = """
with last as (
  select conv_id, arg_max(t, struct_pack(t := t, x := coalesce(x, ''))) as last_turn, arg_max(coalesce(x, ''), struct_pack(t := t, x := coalesce(x, ''))) as answer
  from (select conv_id, turn t, text x from conversations where role = 'assistant' and conv_id is not null and turn is not null) group by 1),
sides as (
  select conv_id, 'c' side, turn, coalesce(role, '') role, coalesce(text, '') x from conversations where conv_id is not null and turn is not null
  union all
  select c.conv_id, 'r', c.turn, coalesce(c.role, ''), coalesce(c.text, '') from conversations c left join last l on c.conv_id = l.conv_id
  where c.conv_id is not null and c.turn is not null and (l.last_turn is null or c.turn < l.last_turn)
  union all
  select a.conv_id, 'r', a.last_turn, 'assistant', b.answer from last a join last b on b.conv_id = a.conv_id + 1),
rows as (
  select *, row_number() over (partition by conv_id, side order by turn, role, x) n,
    '<|im_start|>' || role || chr(10) || x || '<|im_end|>' || chr(10) body,
    (length(role) + 13) || ':0,' || (length(x) + 10) || case when role = 'assistant' then ':1' else ':0' end || ',1:0' mask from sides),
cut as (
  select coalesce(c.conv_id, r.conv_id) conv_id, coalesce(min(case when c.role is not distinct from r.role and c.x is not distinct from r.x then null else coalesce(c.n, r.n) end), max(c.n) + 1) - 1 p
  from (select * from rows where side = 'c') c full join (select * from rows where side = 'r') r on c.conv_id = r.conv_id and c.n = r.n group by 1)
select u.conv_id, cast(any_value(p) as bigint) n_prompt_turns,
  coalesce(string_agg(body, '' order by n) filter (side = 'c' and n <= p), '') prompt,
  coalesce(string_agg(body, '' order by n) filter (side = 'c' and n > p), '') chosen,
  coalesce(string_agg(body, '' order by n) filter (side = 'r' and n > p), '') rejected,
  coalesce(string_agg(mask, ',' order by n) filter (side = 'c' and n > p), '') chosen_mask,
  coalesce(string_agg(mask, ',' order by n) filter (side = 'r' and n > p), '') rejected_mask
from rows u join cut using (conv_id) group by 1
"""


@query
def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair: its own last answer against the next conversation's."""
    from regspark.llm.preference import mask_of, preferences, swapped_answers

    rows = preferences(swapped_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return rows.select(F.col("pair").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", "rejected",
                       mask_of(F.col("chosen_segments")).alias("chosen_mask"), mask_of(F.col("rejected_segments")).alias("rejected_mask"))


ORACLES["op9_preferences"] = OP9_SQL


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the rule spans, and all spans."""
    from regspark.llm.pii import find, joined

    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that the paragraphs of every document name."""
    from regspark.llm.licenses import scan

    return scan(documents(spark, sf_dir))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first eight components of the corpus, whitened."""
    from regspark.llm.whitening import whiten

    w = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    explained = F.array(*map(F.lit, w.explained)).cast("array<double>")
    rows = w.rows.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(F.col("id").alias("vec_id"), (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("k")).alias("explained"), F.lit(w.identity_error).cast("double").alias("identity_error"))


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that a document with a smaller id has."""
    from regspark.llm.passages import without_repeats

    rows = without_repeats(documents(spark, sf_dir).select("doc_id", "text"), window=13, from_files=True)
    removed = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + c["to"] - c["from"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, with one period of each kept."""
    from regspark.llm.periods import periodic_runs, with_planted_period

    rows = periodic_runs(with_planted_period(documents(spark, sf_dir).select("doc_id", "text")), least=12)
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    runs = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").cast("long").alias("exponent_milli"), F.sha2(runs, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
