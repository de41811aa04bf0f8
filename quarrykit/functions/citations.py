"""Citations in answers: finding, numbering and checking them. All row-local on arrays.

Bracket tokens are `[letters, digits, underscores]`. Known ids also count as cited by plain occurrence where said so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import citation_snippet, strip_space

TOKEN = "\\[([A-Za-z0-9_]+)\\]"


@dataclass(frozen=True)
class CitationPolicy:
    min_citations: int = 0
    max_hallucinated: int = 0
    min_density: float = 0.0
    require_timeline_chunk_ids: bool = False
    max_repair_attempts: int = 0
    warn_on_unused_chunks: bool = False


#: Fixed: the two presets.
LENIENT = CitationPolicy()
STRICT = CitationPolicy(min_citations=1, min_density=0.5, require_timeline_chunk_ids=True, max_repair_attempts=1, warn_on_unused_chunks=True)


def extract_citations(answer: Column, known: Column) -> Column:
    """Known ids (or urls) that occur anywhere in the answer, in known order; repeats stay, empty ids go."""
    return F.filter(known, lambda x: (x != "") & F.contains(answer, x))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once for each row however often it is used."""
    return F.transform(F.array(value), use)[0]


def find_bracket_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)))


def numberize(answer: Column, opened: Column) -> tuple[Column, Column]:
    """(text with `[1]`, `[2]` for known bracket ids by first appearance, map of number, id, title, section, snippet).

    `opened` is array<struct<chunk_id, title, section, text>>; the last of equal ids counts. Ids are first replaced by
    private markers, so that an id which is itself a number cannot be replaced twice.
    """
    ids = F.transform(F.coalesce(opened, F.array()), lambda o: o["chunk_id"])
    cited = F.filter(find_bracket_ids(answer), lambda x: F.array_contains(ids, x))
    marked = F.aggregate(F.transform(cited, lambda x, i: F.struct(x.alias("id"), (i + 1).cast("string").alias("n"))), answer, lambda t, c: F.replace(t, F.concat(F.lit("["), c["id"], F.lit("]")), F.concat(F.lit("[\ue000"), c["n"], F.lit("\ue001]"))))
    text = F.replace(F.replace(marked, F.lit("[\ue000"), F.lit("[")), F.lit("\ue001]"), F.lit("]"))

    def entry(x: Column, i: Column) -> Column:
        o = F.element_at(F.filter(opened, lambda o: o["chunk_id"] == x), -1)
        return F.struct((i + 1).cast("int").alias("number"), x.alias("chunk_id"), F.coalesce(o["title"], F.lit("Untitled")).alias("title"), o["section"].alias("section"), citation_snippet(o["text"]).alias("snippet"))

    return F.when(F.size(cited) > 0, text).otherwise(answer), F.transform(cited, entry)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip_space(text), "\\n\\s*\\n"), strip_space), lambda p: p != "")


def _listed(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def validate(answer: Column, opened_ids: Column, policy: CitationPolicy, timeline: Column | None = None) -> Column:
    """struct of valid, errors, warnings, cited_ids, hallucinated_ids, uncited_opened_ids and paragraph counts."""
    if policy.min_density > 0:
        return once(find_bracket_ids(answer), lambda found: once(paragraphs(answer), lambda parts: _validate(found, parts, opened_ids, policy, timeline)))
    return once(find_bracket_ids(answer), lambda found: _validate(found, None, opened_ids, policy, timeline))


def _validate(found: Column, parts: Column | None, opened_ids: Column, policy: CitationPolicy, timeline: Column | None) -> Column:
    cited = F.filter(found, lambda x: F.array_contains(opened_ids, x))
    invented = F.filter(found, lambda x: ~F.array_contains(opened_ids, x))
    unused = F.filter(opened_ids, lambda x: ~F.array_contains(cited, x))
    errors = [F.when(F.size(cited) < policy.min_citations, F.concat(F.lit("Too few valid citations: "), F.size(cited).cast("string"), F.lit(f" (need >= {policy.min_citations})")))]
    errors.append(F.when(F.size(invented) > policy.max_hallucinated, F.concat(F.lit("Hallucinated chunk IDs: "), _listed(invented))))
    n, with_ids = F.lit(0), F.lit(0)
    if policy.min_density > 0:
        n = F.size(parts)
        with_ids = F.size(F.filter(parts, lambda p: F.exists(opened_ids, lambda x: F.contains(p, x))))
        share = with_ids / F.nullif(n, F.lit(0))
        errors.append(F.when(share < policy.min_density, F.concat(F.lit("Citation density too low: "), F.format_number(share, 2), F.lit(" ("), with_ids.cast("string"), F.lit("/"), n.cast("string"), F.lit(f" paragraphs) (need >= {policy.min_density:.2f})"))))
    all_errors = F.filter(F.array(*errors), lambda e: e.isNotNull())
    if policy.require_timeline_chunk_ids and timeline is not None:

        def item_error(item: Column, i: Column) -> Column:
            ids = F.coalesce(item["supporting_chunk_ids"], F.array().cast("array<string>"))
            bad = F.filter(ids, lambda x: ~F.array_contains(opened_ids, x))
            head = F.concat(F.lit("Timeline item "), i.cast("string"))
            return F.when(F.size(ids) == 0, F.concat(head, F.lit(" has no supporting_chunk_ids"))).when(F.size(bad) > 0, F.concat(head, F.lit(" cites unknown chunks: "), _listed(bad)))

        items = F.filter(F.transform(timeline, item_error), lambda e: e.isNotNull())
        all_errors = F.concat(all_errors, F.coalesce(items, F.array().cast("array<string>")))
    warn = F.when(F.lit(policy.warn_on_unused_chunks) & (F.size(unused) > 0), F.array(F.concat(F.lit("Opened chunks not cited in answer: "), _listed(unused)))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        (F.size(all_errors) == 0).alias("valid"), all_errors.alias("errors"), warn.alias("warnings"), cited.alias("cited_ids"), invented.alias("hallucinated_ids"),
        unused.alias("uncited_opened_ids"), n.cast("int").alias("paragraph_count"), with_ids.cast("int").alias("paragraphs_with_citations"),
    )


def needs_repair(valid: Column, answer: Column, error: Column, attempts: Column, policy: CitationPolicy) -> Column:
    """Not valid and attempts are left; answers that are empty or failed count as valid."""
    fine = valid | (F.coalesce(answer, F.lit("")) == "") | error.isNotNull()
    return ~fine & (attempts < policy.max_repair_attempts)
