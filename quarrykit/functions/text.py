"""Row-local text functions, all built-in expressions (Column -> Column).

Patterns are ASCII for white space and digits, and only \\n ends a line, so that results agree between engines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .markup import visible_text


def strip_space(c: Column) -> Column:
    """Without white space at both ends (`trim` removes spaces only)."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


#: Fixed: markup that goes, in this order (pattern, replacement).
MARKUP = [
    ("(?s)<!--.*?-->", ""),
    ("(?s)<ref[^>]*>.*?</ref>", ""),
    ("<ref[^/]*/\\s*>", ""),
    ("<[^>]+>", ""),
    ("\\{\\{[^{}]*\\}\\}", ""),
    ("\\{\\{[^{}]*\\}\\}", ""),
    ("(?s)\\{\\|.*?\\|\\}", ""),
    ("(?i)\\[\\[(?:category|file|image):[^\\]]*\\]\\]", ""),
    ("\\[\\[[^|\\]]*\\|([^\\]]+)\\]\\]", "$1"),
    ("\\[\\[([^\\]]+)\\]\\]", "$1"),
    ("\\[https?://[^\\s\\]]+\\s+([^\\]]+)\\]", "$1"),
    ("\\[https?://[^\\s\\]]+\\]", ""),
    ("'''", ""),
    ("''", ""),
    ("(?md)^=+\\s*(.*?)\\s*=+$", "$1"),
    ("(?md)^\\*+\\s*", ""),
    ("(?md)^#+\\s*", ""),
    ("(?md)^:+\\s*", ""),
    ("(?md)^;+\\s*", ""),
    ("__[A-Z]+__", ""),
    ("\\n{3,}", "\n\n"),
    ("  +", " "),
]


def strip_wiki_markup(c: Column) -> Column:
    """Readable text of wikitext; null and empty give an empty string."""
    out = F.coalesce(c, F.lit(""))
    for pattern, to in MARKUP:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return strip_space(out)


#: Fixed: the entities of plain pages, for the SQL twins.
ENTITIES = [("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def extract_html_text(c: Column, max_chars: int = 8000) -> Column:
    """Text nodes of a page, one per line, without navigation, scripts and the like; null and empty give an empty string."""

    @F.pandas_udf(StringType())
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: visible_text(page, max_chars))

    return extract(c)


def page_text(status: Column, content_type: Column, body: Column, max_chars: int = 8000) -> dict[str, Column]:
    """text, char_count, fetched, error of a stored response."""
    if not 100 <= max_chars <= 50000:
        raise ValueError("max_chars must be from 100 to 50000")
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    failed = F.coalesce(status, F.lit(0)) >= 400
    text = F.when(failed, "").when(kind.contains("html"), extract_html_text(body, max_chars)).when(kind.contains("text/plain"), F.substring(F.coalesce(body, F.lit("")), 1, max_chars)).otherwise(F.concat(F.lit("[Non-text content: "), F.coalesce(content_type, F.lit("")), F.lit("]")))
    return {"text": text, "char_count": F.length(text), "fetched": ~failed, "error": F.when(failed, F.concat(F.lit("HTTP "), status.cast("string")))}


def make_chunk_id(document_id: Column, start: Column, end: Column, name: Column, settings: Column) -> Column:
    """First 16 hex digits of SHA-256 over `document|start|end|name|settings`; the content is not part of it."""
    return F.substring(F.sha2(F.concat_ws("|", document_id, start.cast("string"), end.cast("string"), name, settings), 256), 1, 16)


def snippet(c: Column, n: int = 200) -> Column:
    return F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" "))


def citation_snippet(c: Column, n: int = 150) -> Column:
    """The first n characters, cut back to a word's end (unless that loses over half), with an ellipsis if cut."""
    text = F.coalesce(c, F.lit(""))
    head = strip_space(F.substring(text, 1, n))
    last = F.length(head) - F.instr(F.reverse(head), " ")  # index of the last space, from 0
    back = F.when((F.instr(head, " ") > 0) & (last > n // 2), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) > n, F.concat(back, F.lit("…"))).otherwise(head)


def token_count(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4).cast("long")


def estimate_tokens(c: Column) -> Column:
    """0 without text, else a quarter of the characters, at least 1."""
    n = F.coalesce(F.length(c), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def fill_token_usage(text: Column, tokens_in: Column, tokens_out: Column) -> tuple[Column, Column]:
    return F.coalesce(tokens_in, F.lit(0)).cast("long"), F.coalesce(tokens_out, estimate_tokens(text)).cast("long")


def normalize_web_results(raw, provider: str):
    """title, url, snippet, source of a provider's result rows (a DataFrame)."""
    have = set(raw.columns)
    first = lambda *names: F.coalesce(*[F.col(x).cast("string") for x in names if x in have], F.lit(""))
    url, text = (first("href", "link"), first("body", "snippet")) if provider == "duckduckgo" else (first("url"), first("content"))
    return raw.select(first("title").alias("title"), url.alias("url"), text.alias("snippet"), F.lit(provider).alias("source"))
