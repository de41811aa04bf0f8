"""Windows over chat messages (conv_id, turn, role, text). Only the last turns are needed, so a hot conversation is cut early."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.text import estimate_tokens


def _from_end(messages: DataFrame) -> DataFrame:
    return messages.withColumn("_back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))


def recent_turns(messages: DataFrame, pairs: int = 4) -> DataFrame:
    """The last 2 * pairs non-empty user and assistant messages of each conversation."""
    some = messages.where(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return _from_end(some).where(F.col("_back") <= 2 * pairs).drop("_back")


def evicted_turns(messages: DataFrame, pairs: int = 4) -> DataFrame:
    """conv_id, evicted: the two messages before the last 2 * pairs, where a conversation has over 2 * pairs + 2."""
    sizes = messages.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * pairs + 2)
    rows = _from_end(messages).where((F.col("_back") > 2 * pairs) & (F.col("_back") <= 2 * pairs + 2)).join(sizes, "conv_id", "left_semi")
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 300))
    lines = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lines.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("evicted"))


def conversation_context(messages: DataFrame, summaries: DataFrame | None = None, max_turns: int = 8) -> DataFrame:
    """conv_id, context: summary first, then the last turns; long assistant texts are cut."""
    last = _from_end(messages).where(F.col("_back") <= max_turns)
    text = F.coalesce("text", F.lit(""))
    role = F.concat(F.upper(F.substring("role", 1, 1)), F.lower(F.expr("substring(role, 2)")))
    cut = F.when((role == "Assistant") & (F.length(text) > 500), F.concat(F.substring(text, 1, 500), F.lit("…"))).otherwise(text)
    grouped = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(role, F.lit(": "), cut).alias("line")))).alias("l"))
    if summaries is not None:
        grouped = grouped.join(summaries.select("conv_id", "summary"), "conv_id", "full_outer")
    else:
        grouped = grouped.withColumn("summary", F.lit(None).cast("string"))
    has_summary, has_turns = F.coalesce("summary", F.lit("")) != "", F.coalesce(F.size("l"), F.lit(0)) > 0
    parts = F.concat(
        F.lit("--- CONVERSATION CONTEXT ---"),
        F.when(has_summary, F.concat(F.lit("\nSummary of earlier discussion: "), F.col("summary"), F.lit("\n"))).otherwise(""),
        F.when(has_turns, F.concat(F.lit("\nRecent conversation:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))).otherwise(""),
    )
    return grouped.select("conv_id", F.when(has_summary | has_turns, parts).otherwise("").alias("context"))


def message_tokens(messages: DataFrame) -> DataFrame:
    """conv_id, tokens: 4 more than each text's estimate, and 3 per conversation."""
    return messages.groupBy("conv_id").agg((F.sum(estimate_tokens(F.col("text")) + 4) + 3).alias("tokens"))
