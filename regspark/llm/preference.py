"""Preference data: prompt, chosen and rejected completion from two conversations that begin alike.

The longest common prefix of turns (same role and text) is rendered once as the prompt; what each side adds is its
completion, in segments that say whether they are trained on: the content and end mark of assistant turns are, headers and
other roles are not. All of it is DataFrame expressions; a conversation becomes one row, as its prompt is one text.

Turns go by number, then role, then text; numbers need not be gapless, and turns that repeat stay. A null role or text
counts as empty. A side that is missing has no turns; if both sides are equal the whole is prompt and both completions
are empty. Rows without pair or turn number belong to no conversation and are left out. Extra columns are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the chat template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = ["assistant"]


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _segments(turns: Column) -> Column:
    """Header, content and line end of each turn, with what is trained on."""
    own = lambda t: t["role"].isin(TRAINED)
    part = lambda text, trained: F.struct(text.alias("text"), trained.alias("trained"))
    return F.flatten(F.transform(turns, lambda t: F.array(part(_header(t), F.lit(False)), part(F.concat(t["text"], F.lit(END)), own(t)), part(F.lit("\n"), F.lit(False)))))


def _text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def mask_of(segments: Column) -> Column:
    """``length:flag`` of each segment, joined by commas; lengths in code points."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.length(s["text"]).cast("string"), F.when(s["trained"], ":1").otherwise(":0"))), ",")


def preferences(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``pair, n_prompt_turns, prompt, chosen, rejected`` (texts)``, chosen_segments, rejected_segments``. side: 'chosen' or 'rejected'."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    of = lambda name: F.sort_array(F.collect_list(F.when(F.col(side) == name, one)))
    both = (turns.filter(F.col(pair).isNotNull() & F.col(turn).isNotNull() & F.col(side).isin("chosen", "rejected"))
            .groupBy(F.col(pair).alias("pair")).agg(of("chosen").alias("c"), of("rejected").alias("r")))
    differ = F.transform(F.arrays_zip("c", "r"), lambda x, i: F.when(~(x["c"]["role"].eqNullSafe(x["r"]["role"]) & x["c"]["text"].eqNullSafe(x["r"]["text"])), i))
    cut = both.withColumn("n", F.coalesce(F.array_min(differ), F.size("c")))
    rest = lambda c: _segments(F.slice(c, F.col("n") + 1, F.size(c)))
    return (cut.withColumns({"p": _segments(F.slice("c", F.lit(1), F.col("n"))), "chosen_segments": rest("c"), "rejected_segments": rest("r")})
            .select("pair", F.col("n").cast("long").alias("n_prompt_turns"), _text(F.col("p")).alias("prompt"), _text(F.col("chosen_segments")).alias("chosen"),
                    _text(F.col("rejected_segments")).alias("rejected"), "chosen_segments", "rejected_segments"))


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Pairs from single conversations (conv_id, turn, role, text): the chosen side is the conversation; the rejected side has, in place of
    everything from its last assistant turn on, the last assistant turn of the conversation with the next id, if there is one."""
    known = turns.filter("conv_id is not null and turn is not null")
    last = (known.filter("role = 'assistant'").groupBy("conv_id")
            .agg(F.max(F.struct("turn", "text")).alias("l")).select("conv_id", F.col("l.turn").alias("at"), F.col("l.text").alias("answer")))
    row = lambda name, at, text: [F.col("conv_id").alias("pair_id"), F.lit(name).alias("side"), F.col(at).alias("turn"), F.col("role"), F.col(text).alias("text")]
    kept = known.join(last.drop("answer"), "conv_id", "left").filter("at is null or turn < at")
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("other"))
    swapped = last.join(other, "conv_id").withColumn("role", F.lit("assistant"))
    return known.select(*row("chosen", "turn", "text")).union(kept.select(*row("rejected", "turn", "text"))).union(swapped.select(*row("rejected", "at", "other")))
