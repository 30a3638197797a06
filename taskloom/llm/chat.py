"""Preference formatting, in DataFrame functions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as the
prompt; the turns after it are the completions, with the character spans that are trained on: what assistants
say and its end mark. Prompts, headers and other roles are masked.

Turns are compared by hash, with a row for each pair and turn, so a very long conversation is spread over its
turns; the first turn that differs, or that one side lacks, is a minimum for each pair. The texts of a pair come
together in one row, which is what a preference pair is; Spark's limit of 2 GB for a value is the limit for a pair.
For longer ones ``block`` cuts the output (not the comparison) into a row for each so many turns, numbered by
``block``, whose spans count from the begin of their row.

Null texts and roles are empty, null turns come before turn 0. Repeated rows count once. Different rows of one
turn are in order of role and text. A side without rows has no turns, so all turns of the other side are its
completion. ``differ`` is false where both sides are the same. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import prepare

HEAD, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"


def _spans(messages: Column) -> Column:
    """Spans ``start-end`` in code points that are trained on, joined by commas."""
    head = lambda m: F.length(m["role"]) + len(HEAD) + len(AFTER_ROLE)
    body = lambda m: F.length(m["text"]) + len(END)

    def add(acc: Column, m: Column) -> Column:
        begin = acc["at"] + head(m)
        end = begin + body(m)
        span = F.when(m["role"] == "assistant", F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(messages, start, add, lambda acc: F.array_join(acc["spans"], ","))


def _render(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(HEAD), m["role"], F.lit(AFTER_ROLE), m["text"], F.lit(END))), "")


def preferences(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int | None = None) -> DataFrame:
    """A row for each pair: pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans, prompt_turns, differ.

    ``pair`` gives a row's pair, ``chosen`` whether the row is of the chosen side. ``prompt_turns`` counts the
    turns of the whole prompt. With ``block``, a row for each pair and block of so many turns, and its number.
    """
    prepare(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(pair.alias("pair_id"), F.coalesce(chosen, F.lit(False)).alias("side"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).distinct()
    code = [F.xxhash64("role", "text"), F.xxhash64("text", F.lit(1), "role")]
    sides = [F.bit_xor(F.when(F.col("side") == s, h)).alias(f"{n}{k}") for s, n in ((True, "a"), (False, "b")) for k, h in enumerate(code)]
    each = rows.groupBy("pair_id", "turn").agg(*sides)
    same = F.coalesce((F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1")), F.lit(False))
    prefix = each.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("fork"))
    fork = prefix.select(F.col("pair_id").alias("p"), "fork")
    early = each.join(fork, each["pair_id"].eqNullSafe(fork["p"])).where("fork is null or turn < fork").groupBy("p").agg(F.count("*").alias("prompt_turns"))
    early = early.select(F.col("p").alias("q"), "prompt_turns")
    rows = rows.join(fork, F.col("pair_id").eqNullSafe(F.col("p"))).join(early, F.col("pair_id").eqNullSafe(F.col("q")), "left")
    rows = rows.withColumn("part", F.when(F.col("fork").isNull() | (F.col("turn") < F.col("fork")), F.when(F.col("side"), F.lit("prompt"))).when(F.col("side"), F.lit("chosen")).otherwise("rejected")).where("part is not null")
    keys = [F.col("pair_id")] if block is None else [F.col("pair_id"), F.floor(F.col("turn") / block).cast("long").alias("block")]
    listed = [F.sort_array(F.collect_list(F.when(F.col("part") == n, F.struct("turn", "role", "text")))).alias(n) for n in ("prompt", "chosen", "rejected")]
    out = rows.groupBy(*keys).agg(*listed, F.first(F.coalesce("prompt_turns", F.lit(0))).alias("prompt_turns"), F.first(F.col("fork").isNotNull()).alias("differ"))
    return out.select("pair_id", *["block"] * (block is not None), _render(F.col("prompt")).alias("prompt"), _render(F.col("chosen")).alias("chosen"), _render(F.col("rejected")).alias("rejected"), _spans(F.col("chosen")).alias("chosen_spans"), _spans(F.col("rejected")).alias("rejected_spans"), F.col("prompt_turns").cast("long").alias("prompt_turns"), "differ")
