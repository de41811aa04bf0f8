"""Parsing of model outputs, tolerant of code fences, trailing commas and malformed elements. All row-local.

JSON goes through the variant type, whose null marks invalid input; reading arrays of structs directly would lose a whole
array for one bad element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip_space

MAX_SUB_QUESTIONS = 5
NO_EVIDENCE = "I don't have enough evidence in the provided articles to fully answer this question."


def strip_fences(c: Column) -> Column:
    return strip_space(F.regexp_replace(F.regexp_replace(strip_space(c), "^```(?:json)?\\s*", ""), "\\s*```$", ""))


def parse_sub_questions(raw: Column) -> Column:
    """The first five trimmed, non-empty questions of a JSON array of strings, or null: SINGLE, invalid or under two."""
    text = strip_fences(raw)
    parsed = F.try_parse_json(text)
    whole = F.schema_of_variant(parsed)
    kept = F.filter(F.transform(F.try_variant_get(parsed, "$", "array<string>"), strip_space), lambda q: q != "")
    single = F.upper(strip_space(raw)).startswith("SINGLE")
    return F.when(~single & (whole == "ARRAY<STRING>") & (F.size(kept) >= 2), F.slice(kept, 1, MAX_SUB_QUESTIONS))


def parse_timeline(raw: Column, known_ids: Column | None = None) -> tuple[Column, Column]:
    """(array of date, event, supporting_chunk_ids; error). Entries without date or event are left out."""
    text = strip_fences(raw)
    parsed = F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, ",\\s*([}\\]])", "$1")))
    empty = text.isin("", "[]")
    entries = F.try_variant_get(parsed, "$", "array<variant>")
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")

    def has(v: Column, key: str) -> Column:
        return F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(v, f"$.{key}", "variant").isNotNull()

    def item(v: Column) -> Column:
        ids = F.try_variant_get(v, "$.supporting_chunk_ids", "variant")
        listed = F.when(F.schema_of_variant(ids).startswith("ARRAY"), F.try_variant_get(ids, "$", "array<string>")).when(ids.isNotNull(), F.array(F.try_variant_get(ids, "$", "string")))
        listed = F.coalesce(listed, F.array().cast("array<string>"))
        if known_ids is not None:
            listed = F.filter(listed, lambda x: F.array_contains(known_ids, x))
        return F.struct(F.try_variant_get(v, "$.date", "string").alias("date"), F.try_variant_get(v, "$.event", "string").alias("event"), listed.alias("supporting_chunk_ids"))

    none = F.array().cast("array<struct<date:string,event:string,supporting_chunk_ids:array<string>>>")
    items = F.transform(F.filter(entries, lambda v: has(v, "date") & has(v, "event")), item)
    error = F.when(empty, None).when(parsed.isNull(), "Could not parse timeline JSON").when(~is_list, "Expected JSON array")
    return F.when(empty | error.isNotNull(), none).otherwise(items), error


def timeline_citations(timeline: Column) -> Column:
    """Distinct ids that a timeline cites, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(timeline, lambda t: t["supporting_chunk_ids"]))))


def merge_sub_results(results: DataFrame) -> DataFrame:
    """One row per parent: parts in sub-question order (parent, pos, retrieved, opened, citations, web_citations, tokens)."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "retrieved", "opened", "citations", "web_citations")))
    grouped = results.groupBy("parent").agg(parts.alias("p"), F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"))
    joined = lambda name: F.flatten(F.filter(F.transform("p", lambda x: x[name]), lambda x: x.isNotNull()))
    return grouped.select("parent", joined("retrieved").alias("retrieved"), joined("opened").alias("opened"), F.array_distinct(joined("citations")).alias("citations"), F.array_distinct(joined("web_citations")).alias("web_citations"), "tokens_in", "tokens_out")


def combine_sub_answers(answers: Column) -> Column:
    """A fixed text without rows, a lone non-empty answer as it is, else all non-empty ones with a blank line between."""
    some = F.filter(answers, lambda a: a.isNotNull() & (a != ""))
    return F.when(F.coalesce(F.size(answers), F.lit(0)) <= 0, NO_EVIDENCE).otherwise(F.array_join(some, "\n\n"))
