"""Prompt blocks from arrays, and filling of templates."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _numbered(items: Column, line) -> Column:
    return F.transform(items, lambda x, i: line(x, (i + 1).cast("string")))


def evidence_block(opened: Column) -> Column:
    """`opened`: array<struct<chunk_id, title, section, text>>."""
    section = lambda o: F.when(F.coalesce(o["section"], F.lit("")) != "", F.concat(F.lit(" > "), o["section"])).otherwise("")
    return F.array_join(_numbered(opened, lambda o, n: F.concat(F.lit("--- Evidence "), n, F.lit(": ["), o["chunk_id"], F.lit("] "), o["title"], section(o), F.lit(" ---\n"), o["text"])), "\n\n")


def timeline_section(timeline: Column) -> Column:
    refs = lambda t: F.when(F.size(t["supporting_chunk_ids"]) > 0, F.array_join(t["supporting_chunk_ids"], ", ")).otherwise("no source")
    lines = F.transform(timeline, lambda t: F.concat(F.lit("• "), t["date"], F.lit(": "), t["event"], F.lit("  ["), refs(t), F.lit("]")))
    head = F.lit("--- TIMELINE (for reference while writing your answer) ---\n")
    return F.when(F.size(timeline) > 0, F.concat(head, F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def web_results_block(results: Column) -> Column:
    return F.array_join(_numbered(results, lambda r, n: F.concat(F.lit("[Web "), n, F.lit("] "), r["title"], F.lit("\nURL: "), r["url"], F.lit("\n"), r["snippet"])), "\n\n")


def sub_answers_block(parts: Column) -> Column:
    return F.array_join(_numbered(parts, lambda p, n: F.concat(F.lit("[Part "), n, F.lit("] "), F.coalesce(p["question"], F.concat(F.lit("Sub-question "), n)), F.lit("\n"), F.coalesce(p["answer_text"], F.lit("(no answer)")))), "\n\n")


def prompt_version(template: str) -> str:
    return "v-" + hashlib.sha256(template.encode()).hexdigest()[:8]


def build_prompts(rows: DataFrame, template: str, extra: str = "") -> DataFrame:
    """`rows` with prompt and prompt_version: `{column}` placeholders of the template are filled from columns."""
    missing = sorted(set(re.findall(r"\{(\w+)\}", template)) - set(rows.columns))
    if missing:
        raise ValueError(f"the template needs columns that are missing: {missing}")
    pieces = [F.coalesce(F.col(x).cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if x]
    head = [F.lit(extra + "\n\n")] if extra else []
    return rows.withColumn("prompt", F.concat(*head, *pieces)).withColumn("prompt_version", F.lit(prompt_version(template)))


def prompt_meta(evidence: Column, timeline: Column, chat: Column, summary: Column) -> Column:
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("int")
    return F.struct(size(evidence).alias("evidence_count"), size(timeline).alias("timeline_count"), size(chat).alias("chat_turns"), (F.coalesce(summary, F.lit("")) != "").alias("has_summary"))
