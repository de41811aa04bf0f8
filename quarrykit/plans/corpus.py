"""Registered queries over documents and pages: ingest, cleaning, chunking, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import dates, text
from quarrykit.functions.markup import DROPPED
from quarrykit.operators import chunking, profiling
from quarrykit.sources import mediawiki, tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark, sf_dir: str) -> DataFrame:
    """documents as articles: page_id, title, text, text_length."""
    body = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.concat_ws("/", "source", "doc_id").alias("title"), body.alias("text"), F.length(body).cast("long").alias("text_length"))


def fixed_chunks(spark, sf_dir: str) -> DataFrame:
    return chunking.chunk_fixed(articles(spark, sf_dir))


def paragraph_chunks(spark, sf_dir: str) -> DataFrame:
    """The documents have single line feeds only, so each line counts as a paragraph."""
    return chunking.chunk_paragraphs(articles(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


ARTICLES = "articles AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, concat_ws('/', source, doc_id) AS title, coalesce(text, '') AS text, length(coalesce(text, '')) AS text_length FROM documents)"
FIXED = (
    ARTICLES
    + """,
fixed AS (SELECT page_id AS document_id, title, CAST(s AS BIGINT) AS start_char, CAST(least(s + 1000, length(text)) AS BIGINT) AS end_char, substr(text, CAST(s + 1 AS BIGINT), 1000) AS text FROM articles, unnest(range(0, length(text), 800)) AS t(s) WHERE s = 0 OR least(s + 1000, length(text)) - s >= 100),
chunks AS (SELECT sha256(concat_ws('|', document_id, start_char, end_char, 'fixed_size', 'size=1000,overlap=200,min=100'))[1:16] AS chunk_id, document_id, title, '' AS section, text, start_char, end_char, CAST(length(text) AS BIGINT) AS text_length, 'fixed_size' AS chunker_name, 'size=1000,overlap=200,min=100' AS chunker_settings FROM fixed)"""
)
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
PARAGRAPHS = (
    ARTICLES
    + f""",
parts AS (SELECT page_id, title, i, {STRIP("p[i]")} AS clean, CAST(list_sum(list_transform(p[1:i-1], lambda x: length(x) + 2)) AS BIGINT) AS before, length(p[i]) AS raw FROM (SELECT page_id, title, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM articles), unnest(range(1, len(p) + 1)) AS t(i)),
kept AS (SELECT *, coalesce(before, 0) AS s, length(clean) AS n, row_number() OVER (PARTITION BY page_id ORDER BY i) AS r FROM parts WHERE clean <> ''),
fold AS (SELECT page_id, r, 0 AS chunk, n AS used FROM kept WHERE r = 1 UNION ALL SELECT k.page_id, k.r, CASE WHEN f.used + k.n > 1000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + k.n > 1000 THEN k.n ELSE f.used + k.n END FROM fold f JOIN kept k ON k.page_id = f.page_id AND k.r = f.r + 1),
pchunks AS (SELECT k.page_id AS document_id, any_value(title) AS title, string_agg(clean, chr(10) || chr(10) ORDER BY k.r) AS text, min(s) AS start_char, max(s + raw) AS end_char FROM kept k JOIN fold f ON k.page_id = f.page_id AND k.r = f.r GROUP BY k.page_id, chunk),
chunks AS (SELECT sha256(concat_ws('|', document_id, start_char, end_char, 'paragraph_aware', 'target=1000,max=1500,min=100'))[1:16] AS chunk_id, document_id, title, '' AS section, text, CAST(start_char AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char, CAST(length(text) AS BIGINT) AS text_length, 'paragraph_aware' AS chunker_name, 'target=1000,max=1500,min=100' AS chunker_settings FROM pchunks WHERE length(text) >= 100)"""
)


@query("chunk_fixed", f"WITH {FIXED} SELECT * FROM chunks")
def chunk_fixed(spark, sf_dir):
    return fixed_chunks(spark, sf_dir)


@query("chunk_paragraphs", f"WITH RECURSIVE {PARAGRAPHS} SELECT * FROM chunks")
def chunk_paragraphs(spark, sf_dir):
    return paragraph_chunks(spark, sf_dir)


@query("chunk_summary", f"WITH {FIXED} SELECT (SELECT count(*) FROM articles) AS num_articles, count(*) AS num_chunks, round(sum(text_length) / greatest(count(*), 1), 1) AS avg_chunk_len FROM chunks")
def chunk_summary(spark, sf_dir):
    return chunking.chunk_summary(articles(spark, sf_dir), fixed_chunks(spark, sf_dir))


COMPARED = f"""WITH RECURSIVE {FIXED.replace("chunks AS", "fchunks AS")}, {PARAGRAPHS.removeprefix(ARTICLES + ",")},
both_ AS (SELECT * FROM fchunks UNION ALL SELECT * FROM chunks)"""


@query("compare_chunkers", f"{COMPARED} SELECT chunker_name, count(*) AS n_chunks, min(text_length) AS min_len, max(text_length) AS max_len, round(avg(text_length), 6) AS mean_len FROM both_ GROUP BY chunker_name")
def compare_chunkers(spark, sf_dir):
    made = chunking.compare_chunkers(fixed_chunks(spark, sf_dir).unionByName(paragraph_chunks(spark, sf_dir)))
    return made.withColumn("mean_len", F.round("mean_len", 6))


@query("chunks_per_document", f"{COMPARED} SELECT document_id, count(*) FILTER (chunker_name = 'fixed_size') AS fixed_size, count(*) FILTER (chunker_name = 'paragraph_aware') AS paragraph_aware FROM both_ GROUP BY document_id")
def chunks_per_document(spark, sf_dir):
    return chunking.chunks_per_document(fixed_chunks(spark, sf_dir).unionByName(paragraph_chunks(spark, sf_dir)))


@query(
    "diff_chunk_tables",
    f"""WITH {FIXED}, other AS (SELECT chunk_id, CASE WHEN start_char > 0 THEN upper(text) ELSE text END AS text FROM chunks WHERE end_char < 2000)
SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'left' WHEN a.chunk_id IS NULL THEN 'right' ELSE 'changed' END AS side FROM chunks a FULL JOIN other b ON a.chunk_id = b.chunk_id WHERE a.text IS DISTINCT FROM b.text""",
)
def diff_chunk_tables(spark, sf_dir):
    a = fixed_chunks(spark, sf_dir)
    b = a.where("end_char < 2000").withColumn("text", F.when(F.col("start_char") > 0, F.upper("text")).otherwise(F.col("text")))
    return chunking.diff_chunk_tables(a, b)


#: Wikitext around a document's text: literal pieces and the columns between them.
_WIKI = [
    "'''", "doc_id", "''' is [[Main page|", "head",
    "]] {{box|a={{b}}}}<!-- note\nmore --> <ref name=\"x\">cite</ref> <b>kept</b>\n== Head ==\n* [[Plain]] [https://example.org/a shown] [https://example.org/b]\n{| class=t\n| cell\n|}\n",
    "text", "\n\n\n\n[[Category:Things]] [[File:a.png|thumb]] __NOTOC__",
]
_WIKI_SQL = {"doc_id": "CAST(doc_id AS VARCHAR)", "head": "substr(coalesce(text, ''), 1, 20)", "text": "coalesce(text, '')"}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


RAW = " || ".join(_WIKI_SQL[x] if i % 2 else quoted(x) for i, x in enumerate(_WIKI))


def _strip_sql(x: str) -> str:
    out = x
    for pattern, to in text.MARKUP:
        pattern, to = pattern.replace("(?md)", "(?m)"), to.replace("$1", "\\1")
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return STRIP(out)


def wikitext(spark, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    columns = {"doc_id": F.col("doc_id").cast("string"), "head": F.substring(body, 1, 20), "text": body}
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(*(columns[x] if i % 2 else F.lit(x) for i, x in enumerate(_WIKI))).alias("raw"))


@query("strip_wiki_markup", f"SELECT doc_id, {_strip_sql(RAW)} AS text FROM documents")
def strip_wiki_markup(spark, sf_dir):
    return wikitext(spark, sf_dir).select("doc_id", text.strip_wiki_markup(F.col("raw")).alias("text"))


def page_xml(spark, sf_dir: str) -> DataFrame:
    """Pages in dump form (xml): every 7th a redirect, every 11th outside the main namespace."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    xml = F.concat(
        F.lit("<page><title>"), escape(F.concat_ws("/", "source", "doc_id")), F.lit("</title><ns>"), F.when(i % 11 == 0, "1").otherwise("0"), F.lit("</ns><id>"), i.cast("string"), F.lit("</id>"),
        F.when(i % 7 == 0, '<redirect title="x" />').otherwise(""), F.lit("<revision><id>r"), i.cast("string"), F.lit('</id><text xml:space="preserve">'), escape(F.coalesce("text", F.lit(""))), F.lit("</text></revision></page>"),
    )
    return d.select(xml.alias("xml"))


def xml_pages(spark, sf_dir: str) -> DataFrame:
    return mediawiki.parse_pages(page_xml(spark, sf_dir))


INGESTED = f"ingested AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, concat_ws('/', source, doc_id) AS title, {_strip_sql('text')} AS text FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND text <> '')"


@query("ingest_articles", f"WITH {INGESTED} SELECT page_id, title, text, 'dump' AS source, '2024-01-01' AS ingested_at, CAST(length(text) AS BIGINT) AS text_length FROM ingested WHERE length(text) >= 50")
def ingest_articles(spark, sf_dir):
    return mediawiki.ingest_articles(xml_pages(spark, sf_dir), "dump", "2024-01-01")


@query("ingest_summary", f"WITH {INGESTED} SELECT count(*) FILTER (length(text) >= 50) AS num_articles, CAST(sum(length(text)) FILTER (length(text) >= 50) AS BIGINT) AS total_chars, count(*) FILTER (length(text) < 50) AS skipped FROM ingested")
def ingest_summary(spark, sf_dir):
    return mediawiki.ingest_summary(xml_pages(spark, sf_dir))


def _html_sql(x: str, n: int = 8000) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '(?s)<!--.*?-->|<![^>]*>', '', 'g')"
    for tag in DROPPED:
        out = f"regexp_replace({out}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    out = f"array_to_string(list_filter(list_transform(string_split_regex({out}, '<[^>]+>'), lambda x: {STRIP('x')}), lambda x: x <> ''), chr(10))"
    for entity, char in text.ENTITIES:
        out = f"replace({out}, {quoted(entity)}, {quoted(char)})" if entity != "&amp;" else f"regexp_replace({out}, '&amp;?', '&', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g')"
    return STRIP(f"substr({out}, 1, {n})")


@query("extract_html_text", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def extract_html_text(spark, sf_dir):
    tables.small_batches(spark)
    return read(spark, sf_dir, "pages").select("page_id", text.extract_html_text(F.col("html")).alias("text"))


@query(
    "extract_pages",
    f"""WITH r AS (SELECT page_id, url, html, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status, CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/plain' ELSE 'image/png' END AS ct FROM pages),
t AS (SELECT page_id, url, status, CASE WHEN status >= 400 THEN '' WHEN contains(ct, 'html') THEN {_html_sql("html")} WHEN contains(ct, 'text/plain') THEN substr(html, 1, 8000) ELSE '[Non-text content: ' || ct || ']' END AS text FROM r)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS char_count, status < 400 AS fetched, CASE WHEN status >= 400 THEN 'HTTP ' || status END AS error FROM t""",
)
def extract_pages(spark, sf_dir):
    status = F.when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    kind = F.when(F.col("page_id") % 3 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 1, "text/plain").otherwise("image/png")
    made = text.page_text(status, kind, F.col("html"))
    tables.small_batches(spark)
    return read(spark, sf_dir, "pages").select("page_id", "url", *(c.alias(n) for n, c in made.items())).withColumn("char_count", F.col("char_count").cast("long"))


@query(
    "text_scalars",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, t, {STRIP("substr(t, 1, 150)")} AS h FROM d)
SELECT doc_id, replace(substr(t, 1, 200), chr(10), ' ') AS snippet, CASE WHEN length(t) > 150 THEN CASE WHEN contains(h, ' ') AND length(h) - strpos(reverse(h), ' ') > 75 THEN substr(h, 1, length(h) - strpos(reverse(h), ' ')) ELSE h END || '…' ELSE h END AS citation_snippet,
length(t) // 4 AS tokens, CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, length(t) // 4) END AS estimate FROM s""",
)
def text_scalars(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", text.snippet(t).alias("snippet"), text.citation_snippet(t).alias("citation_snippet"), text.token_count(t).alias("tokens"), text.estimate_tokens(t).alias("estimate"))


@query("fill_token_usage", "SELECT doc_id, CAST(coalesce(CASE WHEN doc_id % 3 = 0 THEN doc_id END, 0) AS BIGINT) AS tokens_in, CAST(coalesce(CASE WHEN doc_id % 2 = 0 THEN 7 END, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) AS BIGINT) AS tokens_out FROM documents")
def fill_token_usage(spark, sf_dir):
    i = F.col("doc_id")
    a, b = text.fill_token_usage(F.col("text"), F.when(i % 3 == 0, i), F.when(i % 2 == 0, 7))
    return read(spark, sf_dir, "documents").select("doc_id", a.alias("tokens_in"), b.alias("tokens_out"))


@query("normalize_web_results", "SELECT regexp_extract(html, '<title>([^<]*)', 1) AS title, url, html AS snippet, 'duckduckgo' AS source FROM pages")
def normalize_web_results(spark, sf_dir):
    raw = read(spark, sf_dir, "pages").select(F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("url").alias("href"), F.col("html").alias("body"))
    return text.normalize_web_results(raw, "duckduckgo")


_NAMES = [m.capitalize() for m, n in list(dates.MONTHS.items())[:12]]
_NAME_SQL = "[" + ", ".join(f"'{m}'" for m in _NAMES) + "][m]"
DATES = f"""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN lpad(CAST(y AS VARCHAR), 4, '0') || '-' || m || '-' || d WHEN 1 THEN m || '/' || d || '/' || (y + 1000) WHEN 2 THEN {_NAME_SQL} || ' ' || d || ', ' || y || ' BC' WHEN 3 THEN d || 'th ' || {_NAME_SQL} || ' ' || y
WHEN 4 THEN 'circa ' || {_NAME_SQL} || ' ' || y WHEN 5 THEN y || ' BCE' WHEN 6 THEN y || '0s' WHEN 7 THEN 'no date ' || d ELSE ' ' END AS raw, y, m, d FROM (SELECT doc_id, doc_id % 800 + 100 AS y, CAST(doc_id % 12 + 1 AS INT) AS m, doc_id % 28 + 1 AS d FROM documents)"""


@query(
    "normalize_date",
    f"""WITH g AS ({DATES}), e AS (SELECT *, doc_id % 9 AS k FROM g)
SELECT doc_id, raw, CASE k WHEN 2 THEN '-' WHEN 5 THEN '-' ELSE '' END || CASE WHEN k IN (0, 2, 3, 4, 5) THEN lpad(CAST(y AS VARCHAR), 4, '0') WHEN k = 1 THEN CAST(y + 1000 AS VARCHAR) WHEN k = 6 THEN y || '0' END || CASE WHEN k IN (0, 1, 2, 3) THEN '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') WHEN k = 4 THEN '-' || lpad(CAST(m AS VARCHAR), 2, '0') ELSE '' END AS iso,
CASE WHEN k IN (0, 1, 2, 3) THEN 'day' WHEN k = 4 THEN 'month' WHEN k = 5 THEN 'year' WHEN k = 6 THEN 'decade' END AS precision, CASE WHEN k IN (2, 5) THEN 'BC' WHEN k < 8 THEN 'AD' END AS era, k = 4 AS approximate, k >= 7 AS failed FROM e""",
)
def normalize_date(spark, sf_dir):
    made = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("i"), (F.col("doc_id") % 800 + 100).alias("y"), (F.col("doc_id") % 12 + 1).cast("int").alias("m"), (F.col("doc_id") % 28 + 1).alias("d"))
    name = F.element_at(F.array(*(F.lit(m) for m in _NAMES)), F.col("m"))
    s = lambda c: F.col(c).cast("string")
    forms = [
        F.concat(F.lpad(s("y"), 4, "0"), F.lit("-"), s("m"), F.lit("-"), s("d")), F.concat(s("m"), F.lit("/"), s("d"), F.lit("/"), (F.col("y") + 1000).cast("string")), F.concat(name, F.lit(" "), s("d"), F.lit(", "), s("y"), F.lit(" BC")),
        F.concat(s("d"), F.lit("th "), name, F.lit(" "), s("y")), F.concat(F.lit("circa "), name, F.lit(" "), s("y")), F.concat(s("y"), F.lit(" BCE")), F.concat(s("y"), F.lit("0s")), F.concat(F.lit("no date "), s("d")), F.lit(" "),
    ]
    raw = F.element_at(F.array(*forms), (F.col("i") % 9 + 1).cast("int"))
    x = made.select("doc_id", raw.alias("raw")).withColumn("x", dates.normalize_date(F.col("raw")))
    return x.select("doc_id", "raw", "x.iso", "x.precision", "x.era", "x.approximate", F.col("x.error").isNotNull().alias("failed"))


@query("length_profile", f"WITH {ARTICLES} SELECT count(*) AS count, CAST(sum(text_length) AS BIGINT) AS sum, round(avg(text_length), 6) AS mean, round(stddev_samp(text_length), 6) AS std, min(text_length) AS min, quantile_cont(text_length, 0.25) AS p25, quantile_cont(text_length, 0.5) AS p50, quantile_cont(text_length, 0.75) AS p75, max(text_length) AS max FROM articles")
def length_profile(spark, sf_dir):
    return profiling.length_profile(articles(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "length_histogram",
    f"""WITH {ARTICLES}, c AS (SELECT least(text_length, 20000)::DOUBLE AS v FROM articles), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 80 AS w FROM c)
SELECT CAST(least(floor((v - lo) / w), 79) AS INT) AS bin, round(lo + CAST(least(floor((v - lo) / w), 79) AS INT) * w, 6) AS low, count(*) AS n FROM c, e GROUP BY ALL""",
)
def length_histogram(spark, sf_dir):
    return profiling.length_histogram(articles(spark, sf_dir)).withColumn("low", F.round("low", 6))


_ENDS = "SELECT page_id, title, text_length, substr(text, 1, 80) AS preview, '{k}' AS kind FROM articles ORDER BY text_length {d}, page_id LIMIT 5"


@query("shortest_longest", f"WITH {ARTICLES} (SELECT * FROM ({_ENDS.format(k='shortest', d='')})) UNION ALL (SELECT * FROM ({_ENDS.format(k='longest', d='DESC')}))")
def shortest_longest(spark, sf_dir):
    return profiling.shortest_longest(articles(spark, sf_dir))


@query("find_titles", f"WITH {ARTICLES} SELECT page_id, title FROM articles WHERE contains(lower(title), 'src1/')")
def find_titles(spark, sf_dir):
    return profiling.find_titles(articles(spark, sf_dir), "SRC1/")


_AUDIT = " UNION ALL ".join(f"SELECT '{label.replace(chr(39), chr(39) * 2)}' AS label, count(*) FILTER (regexp_matches(raw, '{p.replace(chr(39), chr(39) * 2)}')) AS count, count(*) AS n FROM w" for label, p in profiling.LEFTOVERS)


@query("markup_audit", f"WITH w AS (SELECT CASE WHEN doc_id % 20 = 0 THEN {RAW} ELSE text END AS raw FROM documents), a AS ({_AUDIT}) SELECT label, count, round(100 * count / greatest(n, 1), 4) AS percent, CASE WHEN round(100 * count / greatest(n, 1), 4) < 5 THEN 'ok' ELSE 'REVIEW' END AS status FROM a")
def markup_audit(spark, sf_dir):
    rows = wikitext(spark, sf_dir).join(read(spark, sf_dir, "documents"), "doc_id")
    return profiling.markup_audit(rows.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 20 == 0, F.col("raw")).otherwise(F.col("text")).alias("text")))


@query("index_profile", f"WITH {FIXED} SELECT count(*) AS rows, count(DISTINCT title) AS titles, count(DISTINCT document_id) AS documents, min(text_length) AS min_len, quantile_cont(text_length, 0.5) AS median_len, round(avg(text_length), 6) AS mean_len, max(text_length) AS max_len FROM chunks")
def index_profile(spark, sf_dir):
    return profiling.index_profile(fixed_chunks(spark, sf_dir)).withColumn("mean_len", F.round("mean_len", 6))


@query("top_chunked_titles", f"WITH {FIXED} SELECT title, count(*) AS n_chunks FROM chunks GROUP BY title ORDER BY n_chunks DESC, title LIMIT 10")
def top_chunked_titles(spark, sf_dir):
    return profiling.top_chunked_titles(fixed_chunks(spark, sf_dir))
