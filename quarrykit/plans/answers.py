"""Registered queries over conversations, answers, model outputs, evaluation runs, logs and metrics.

The tables hold no answers or model outputs, so the queries derive them from documents and events, in the same way as
their SQL does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import citations, parsing, prompts, routing
from quarrykit.operators import conversations, evaluation, matching, observability

from .corpus import FIXED, STRIP, fixed_chunks, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _alternatives(words: list[str]) -> str:
    return "|".join(words)


ROUTE = f"""q AS (SELECT conv_id, turn, coalesce(text, '') AS text, regexp_replace(lower(coalesce(text, '')), '^\\s+|\\s+$', '', 'g') AS l, regexp_matches(coalesce(text, ''), '[0-9]') AS d FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, turn, text, CASE WHEN regexp_full_match(l, '\\s*[0-9()+*/.\\s^%-]+\\s*') THEN 'math:1.0' WHEN regexp_matches(l, '{_alternatives(routing.STRONG)}') THEN CASE WHEN d THEN 'math:0.9' ELSE 'math:0.8' END WHEN regexp_matches(l, '{_alternatives(routing.WEB)}') THEN 'web_research:0.8'
WHEN regexp_matches(l, '{_alternatives(routing.TIMELINE)}') THEN 'timeline_research:0.8' WHEN d AND regexp_matches(l, '{_alternatives(routing.WEAK)}') THEN 'math:0.8' WHEN regexp_matches(l, '^(who|what|where|why|how|which|is|are|was|were|did|do|does)\\b') THEN 'local_rag:0.5' ELSE 'ambiguous:0.0' END AS r FROM q),
hr AS (SELECT conv_id, turn, text, string_split(r, ':')[1] AS route, CAST(string_split(r, ':')[2] AS DOUBLE) AS confidence FROM h)"""


def questions(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@query("heuristic_route", f"WITH {ROUTE} SELECT conv_id, turn, route, confidence FROM hr")
def heuristic_route(spark, sf_dir):
    route, sure = routing.heuristic_route(F.col("text"))
    return questions(spark, sf_dir).select("conv_id", "turn", route.alias("route"), sure.alias("confidence"))


@query(
    "resolve_route",
    f"""WITH {ROUTE}, m AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'heuristic_only' WHEN 1 THEN 'hybrid' ELSE 'llm_only' END AS mode, CASE WHEN turn % 2 = 0 THEN 'math' END AS label FROM hr),
a AS (SELECT *, label IS NOT NULL AND (mode = 'llm_only' OR (mode <> 'heuristic_only' AND route = 'ambiguous')) AS ask FROM m)
SELECT conv_id, turn, CASE WHEN ask THEN label WHEN route = 'ambiguous' THEN 'local_rag' ELSE route END AS route, CASE WHEN ask THEN 'llm' WHEN route = 'ambiguous' THEN 'fallback' ELSE 'heuristic' END AS method, CASE WHEN ask THEN 0.7 WHEN route = 'ambiguous' THEN CASE WHEN mode = 'heuristic_only' THEN 0.3 ELSE 0.2 END ELSE confidence END::DOUBLE AS confidence FROM a""",
)
def resolve_route(spark, sf_dir):
    mode = F.when(F.col("conv_id") % 3 == 0, "heuristic_only").when(F.col("conv_id") % 3 == 1, "hybrid").otherwise("llm_only")
    made = routing.resolve_route(F.col("text"), mode, F.when(F.col("turn") % 2 == 0, ' "Math".\nbecause'))
    return questions(spark, sf_dir).select("conv_id", "turn", *(c.alias(n) for n, c in made.items()))


@query("parse_route_label", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'web_research' ELSE 'local_rag' END AS label, CASE doc_id % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0.7 END::DOUBLE AS confidence FROM documents")
def parse_route_label(spark, sf_dir):
    i = F.col("doc_id") % 4
    raw = F.when(i == 0, F.concat(F.lit(" 'WEB_research'. "), "text")).when(i == 1, F.concat(F.lit("no such label "), "text")).when(i == 3, F.concat(F.lit("local_rag\n"), "text"))
    label, sure = routing.parse_route_label(raw)
    return read(spark, sf_dir, "documents").select("doc_id", label.alias("label"), sure.alias("confidence"))


@query("effective_query", "SELECT conv_id, turn, CASE WHEN turn > 0 AND length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) BETWEEN 1 AND 300 THEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') ELSE 'asked' END AS query FROM conversations WHERE role = 'user'")
def effective_query(spark, sf_dir):
    made = routing.effective_query(F.lit("asked"), F.col("text"), F.col("turn") > 0)
    return questions(spark, sf_dir).select("conv_id", "turn", made.alias("query"))


@query("parse_sub_questions", "SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 2) THEN CASE doc_id % 5 WHEN 1 THEN 'What is ' || doc_id || '?|Why ' || source || '?' ELSE 'a|b|c|d|' || source END END AS parts FROM documents")
def parse_sub_questions(spark, sf_dir):
    i, n, s = F.col("doc_id") % 5, F.col("doc_id").cast("string"), F.col("source")
    raw = (
        F.when(i == 0, "single question")
        .when(i == 1, F.concat(F.lit('```json\n["What is '), n, F.lit('?", "  ", " Why '), s, F.lit('? "]\n```')))
        .when(i == 2, F.concat(F.lit('["a","b","c","d","'), s, F.lit('","f"]')))
        .when(i == 3, F.concat(F.lit('["only '), s, F.lit('"]')))
        .otherwise(F.concat(F.lit('["a", 1, "'), s, F.lit('"]')))
    )
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(parsing.parse_sub_questions(raw), "|").alias("parts"))


@query(
    "parse_timeline",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_items, CASE doc_id % 4 WHEN 0 THEN source || ',x' WHEN 1 THEN source ELSE '' END AS cited, CASE doc_id % 4 WHEN 2 THEN 'Could not parse timeline JSON' WHEN 3 THEN 'Expected JSON array' END AS error FROM documents""",
)
def parse_timeline(spark, sf_dir):
    i, s = F.col("doc_id") % 4, F.col("source")
    raw = (
        F.when(i == 0, F.concat(F.lit('```json\n[{"date": "1900", "event": "e", "supporting_chunk_ids": ["'), s, F.lit('", "unknown"]}, {"date": 1901, "event": "f", "supporting_chunk_ids": "x"}, "odd", {"date": "no event"},]\n```')))
        .when(i == 1, F.concat(F.lit('[{"date": "1", "event": "e", "supporting_chunk_ids": ["'), s, F.lit('"]}]')))
        .when(i == 2, "not json at all")
        .otherwise('{"date": "1"}')
    )
    rows = read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), F.array(s, F.lit("x")).alias("known"))
    items, error = parsing.parse_timeline(F.col("raw"), F.col("known"))
    return rows.select("doc_id", items.alias("t"), error.alias("error")).select("doc_id", F.size("t").alias("n_items"), F.array_join(parsing.timeline_citations(F.col("t")), ",").alias("cited"), "error")


@query(
    "merge_sub_results",
    """WITH p AS (SELECT doc_id // 5 AS parent, doc_id AS pos, source, lang FROM documents)
SELECT parent, string_agg(source, ',' ORDER BY pos) AS retrieved, (SELECT string_agg(l, ',' ORDER BY f) FROM (SELECT lang AS l, min(pos) AS f FROM p b WHERE b.parent = p.parent GROUP BY lang)) AS citations, CAST(sum(pos) AS BIGINT) AS tokens_in, count(*) AS tokens_out FROM p GROUP BY parent""",
)
def merge_sub_results(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    parts = d.select(F.expr("doc_id div 5").alias("parent"), F.col("doc_id").alias("pos"), F.array("source").alias("retrieved"), F.array("source").alias("opened"), F.array("lang").alias("citations"), F.array("lang").alias("web_citations"), F.col("doc_id").alias("tokens_in"), F.lit(1).alias("tokens_out"))
    made = parsing.merge_sub_results(parts)
    return made.select("parent", F.array_join("retrieved", ",").alias("retrieved"), F.array_join("citations", ",").alias("citations"), "tokens_in", "tokens_out")


@query("combine_sub_answers", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{parsing.NO_EVIDENCE.replace(chr(39), chr(39) * 2)}' WHEN 1 THEN source ELSE source || chr(10) || chr(10) || lang END AS answer FROM documents")
def combine_sub_answers(spark, sf_dir):
    i = F.col("doc_id") % 3
    answers = F.when(i == 0, F.array().cast("array<string>")).when(i == 1, F.array(F.lit(""), F.col("source"))).otherwise(F.array("source", F.lit(""), "lang"))
    return read(spark, sf_dir, "documents").select("doc_id", parsing.combine_sub_answers(answers).alias("answer"))


def answers(spark, sf_dir: str) -> DataFrame:
    """question_id, answer_text, opened (ids c<doc_id>a, b, c with titles), timeline, urls, derived from documents.

    Every answer cites a and b; every third invents an id; every fourth has a second paragraph without a citation.
    """
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    cid = lambda x: F.concat(F.lit("c"), n, F.lit(x))
    chunk = lambda x: F.struct(cid(x).alias("chunk_id"), n.alias("document_id"), F.concat(F.lit("T"), (i % 7).cast("string"), F.lit("" if x == "c" else x)).alias("title"), F.lit(None).cast("string").alias("section"), F.coalesce("text", F.lit("")).alias("text"))
    answer = F.concat(F.lit("First ["), cid("b"), F.lit("]["), cid("a"), F.lit("] and ["), cid("b"), F.lit("]."), F.when(i % 3 == 0, " Also [ghost1].").otherwise(""), F.when(i % 4 == 0, "\n\nNothing here.\n\nNor here.").otherwise(""))
    timeline = F.when(i % 2 == 0, F.array(F.struct(F.lit("1900").alias("date"), F.lit("a|b").alias("event"), F.array(cid("a"), F.lit("zz")).alias("supporting_chunk_ids")), F.struct(F.lit("1901").alias("date"), F.lit("c").alias("event"), F.array().cast("array<string>").alias("supporting_chunk_ids"))))
    urls = F.array(F.concat(F.lit("http://x/"), n))
    return read(spark, sf_dir, "documents").select(i.alias("question_id"), F.col("source").alias("question"), answer.alias("answer_text"), F.array(chunk("a"), chunk("b"), chunk("c")).alias("opened"), timeline.alias("timeline"), urls.alias("urls"), F.when(i % 10 == 0, "failed").alias("error"), (i / 8).alias("model_latency_ms"))


ANSWERS = """a AS (SELECT doc_id, 'c' || doc_id AS c, doc_id % 3 = 0 AS ghost, doc_id % 4 = 0 AS thin, doc_id % 2 = 0 AS timed, doc_id % 7 AS t, doc_id % 10 = 0 AS failed FROM documents)"""


@query("extract_citations", f"WITH {ANSWERS} SELECT doc_id AS question_id, c || 'a,' || c || 'b' AS cited, '' AS web, c || 'b,' || c || 'a' || CASE WHEN ghost THEN ',ghost1' ELSE '' END AS bracketed FROM a")
def extract_citations(spark, sf_dir):
    ids = F.transform("opened", lambda o: o["chunk_id"])
    return answers(spark, sf_dir).select("question_id", *(F.array_join(c, ",").alias(n) for n, c in (("cited", citations.extract_citations(F.col("answer_text"), ids)), ("web", citations.extract_citations(F.col("answer_text"), F.col("urls"))), ("bracketed", citations.find_bracket_ids(F.col("answer_text"))))))


@query("web_citations", "SELECT doc_id AS question_id, CASE WHEN doc_id % 2 = 0 THEN 'http://x/' || doc_id || ',' || 'http://y/' || doc_id ELSE 'http://y/' || doc_id END AS cited, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) END AS n_chars FROM documents")
def web_citations(spark, sf_dir):
    """Urls cited after a whole text: two known ones, the second cited first by odd ids alone, and an unknown one."""
    n = F.col("doc_id").cast("string")
    x, y = F.concat(F.lit("http://x/"), n), F.concat(F.lit("http://y/"), n)
    body = F.translate(F.coalesce("text", F.lit("")), "[]", "()")
    answer = F.concat(body, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" ["), x, F.lit("]"))).otherwise(""), F.lit(" ["), y, F.lit("] [http://unknown/]"))
    cited = citations.extract_citations(answer, F.array(x, y))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.array_join(cited, ",").alias("cited"), F.length(body).alias("n_chars"))


_SENTENCES = "s AS (SELECT DISTINCT sentence FROM (SELECT unnest(string_split(text, '. ')) AS sentence FROM benchmark) WHERE sentence <> '')"


@query("known_sentences", f"WITH {_SENTENCES} SELECT doc_id, sentence FROM documents JOIN s ON contains(text, sentence)")
def known_sentences(spark, sf_dir):
    """Sentences of benchmark passages that stand anywhere in a document, by one pass with an automaton of all of them."""
    known = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\\. ")).alias("sentence"))
    found = matching.known_in_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), known, "doc_id", "sentence")
    return found.withColumnRenamed("known", "sentence")


@query("known_bracket_ids", f"WITH {ANSWERS} SELECT doc_id AS question_id, id FROM a, unnest([c || 'a', c || 'b']) AS t(id)")
def known_bracket_ids(spark, sf_dir):
    """Ids in brackets that any answer has opened, by an equi-join of tokens; invented ones go."""
    made = answers(spark, sf_dir)
    known = made.select(F.explode("opened").alias("o")).select(F.col("o.chunk_id").alias("id"))
    texts = made.select("question_id", F.col("answer_text").alias("text"))
    return matching.known_tokens(texts, known, citations.TOKEN, "question_id", "id").withColumnRenamed("known", "id")


@query(
    "numberize_citations",
    f"""WITH {ANSWERS} SELECT doc_id AS question_id, 'First [1][2] and [1].' || CASE WHEN ghost THEN ' Also [ghost1].' ELSE '' END || CASE WHEN thin THEN chr(10) || chr(10) || 'Nothing here.' || chr(10) || chr(10) || 'Nor here.' ELSE '' END AS text, '1:' || c || 'b:T' || t || 'b|2:' || c || 'a:T' || t || 'a' AS map FROM a""",
)
def numberize_citations(spark, sf_dir):
    text, entries = citations.numberize(F.col("answer_text"), F.col("opened"))
    shown = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["number"].cast("string"), e["chunk_id"], e["title"])), "|")
    return answers(spark, sf_dir).select("question_id", text.alias("text"), shown.alias("map"))


@query(
    "validate_citations",
    f"""WITH {ANSWERS}, e AS (SELECT *, concat_ws('; ', CASE WHEN ghost THEN 'Hallucinated chunk IDs: [''ghost1'']' END, CASE WHEN thin THEN 'Citation density too low: 0.33 (1/3 paragraphs) (need >= 0.50)' END, CASE WHEN timed THEN 'Timeline item 0 cites unknown chunks: [''zz'']; Timeline item 1 has no supporting_chunk_ids' END) AS errors FROM a)
SELECT doc_id AS question_id, errors = '' AS valid, errors, c || 'b,' || c || 'a' AS cited, CASE WHEN ghost THEN 'ghost1' ELSE '' END AS invented, c || 'c' AS unused, CASE WHEN thin THEN 3 ELSE 1 END AS paragraphs, errors <> '' AS repair FROM e""",
)
def validate_citations(spark, sf_dir):
    ids = F.transform("opened", lambda o: o["chunk_id"])
    made = answers(spark, sf_dir).withColumn("v", citations.validate(F.col("answer_text"), ids, citations.STRICT, F.col("timeline")))
    repair = citations.needs_repair(F.col("v.valid"), F.col("answer_text"), F.lit(None).cast("string"), F.lit(0), citations.STRICT)
    joined = lambda c, by=",": F.array_join(f"v.{c}", by)
    return made.select("question_id", "v.valid", joined("errors", "; ").alias("errors"), joined("cited_ids").alias("cited"), joined("hallucinated_ids").alias("invented"), joined("uncited_opened_ids").alias("unused"), F.col("v.paragraph_count").alias("paragraphs"), repair.alias("repair"))


@query(
    "validate_citations_lenient",
    f"WITH {ANSWERS} SELECT doc_id AS question_id, NOT ghost AS valid, CASE WHEN ghost THEN 'Hallucinated chunk IDs: [''ghost1'']' ELSE '' END AS errors, '' AS warnings, c || 'b,' || c || 'a' AS cited, 0 AS paragraphs, false AS repair FROM a",
)
def validate_citations_lenient(spark, sf_dir):
    """Only invented ids are errors, nothing is warned of, and nothing is repaired."""
    ids = F.transform("opened", lambda o: o["chunk_id"])
    made = answers(spark, sf_dir).withColumn("v", citations.validate(F.col("answer_text"), ids, citations.LENIENT, F.col("timeline")))
    repair = citations.needs_repair(F.col("v.valid"), F.col("answer_text"), F.lit(None).cast("string"), F.lit(0), citations.LENIENT)
    joined = lambda c, by=",": F.array_join(f"v.{c}", by)
    return made.select("question_id", "v.valid", joined("errors", "; ").alias("errors"), joined("warnings", "; ").alias("warnings"), joined("cited_ids").alias("cited"), F.col("v.paragraph_count").alias("paragraphs"), repair.alias("repair"))


#: Answers made of texts: a document's first four chunks, those of an even length cited after themselves.
TEXT_ANSWERS = f"""{FIXED},
o AS (SELECT document_id, chunk_id, text, start_char, length(text) % 2 = 0 AS cited, chr(10) || chr(10) || translate(text, '[]', '()') AS part FROM chunks QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY start_char) <= 4),
k AS (SELECT *, CASE WHEN cited THEN row_number() OVER (PARTITION BY document_id, cited ORDER BY start_char) END AS k FROM o),
ta AS (SELECT document_id, string_agg(part || CASE WHEN cited THEN ' [' || chunk_id || ']' ELSE '' END, '' ORDER BY start_char)[3:] || CASE WHEN count(*) % 2 = 1 THEN ' [ghost_1]' ELSE '' END AS answer,
string_agg(part || CASE WHEN cited THEN ' [' || k || ']' ELSE '' END, '' ORDER BY start_char)[3:] || CASE WHEN count(*) % 2 = 1 THEN ' [ghost_1]' ELSE '' END AS numbered,
count(*) % 2 = 1 AS ghost, count(*) AS n, coalesce(list(chunk_id ORDER BY start_char) FILTER (cited), []) AS cited, list(chunk_id ORDER BY start_char) AS ids, coalesce(list(chunk_id ORDER BY start_char) FILTER (NOT cited), []) AS unused FROM k GROUP BY document_id),
tp AS (SELECT *, list_filter(list_transform(string_split_regex({STRIP('answer')}, '\\n\\s*\\n'), lambda x: {STRIP('x')}), lambda x: x <> '') AS parts FROM ta),
tv AS (SELECT *, len(parts) AS paragraphs, len(list_filter(parts, lambda x: len(list_filter(ids, lambda i: contains(x, i))) > 0)) AS with_ids FROM tp)"""


def text_answers(spark, sf_dir: str) -> DataFrame:
    """question_id, answer_text, opened of every document with a text; every odd number of chunks invents an id."""
    w = Window.partitionBy("document_id").orderBy("start_char")
    # Chunks begin every 800 characters and only last ones go, so each row with a chunk from 3200 on has four before it.
    first = fixed_chunks(spark, sf_dir).where("start_char < 3200").withColumn("at", F.row_number().over(w)).where("at <= 4")
    listed = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "document_id", "title", F.lit("").alias("section"), "text"))).alias("o"))
    opened = F.transform("o", lambda o: F.struct(*(o[c].alias(c) for c in ("chunk_id", "document_id", "title", "section", "text"))))
    cite = lambda o: F.when(F.length(o["text"]) % 2 == 0, F.concat(F.lit(" ["), o["chunk_id"], F.lit("]"))).otherwise("")
    parts = F.transform("opened", lambda o: F.concat(F.translate(o["text"], "[]", "()"), cite(o)))
    answer = F.concat(F.array_join(parts, "\n\n"), F.when(F.size("opened") % 2 == 1, " [ghost_1]").otherwise(""))
    return listed.select(F.col("document_id").alias("question_id"), opened.alias("opened")).withColumn("answer_text", answer)


_ERRORS = """concat_ws('; ', CASE WHEN len(cited) < 1 THEN 'Too few valid citations: 0 (need >= 1)' END, CASE WHEN ghost THEN 'Hallucinated chunk IDs: [''ghost_1'']' END,
CASE WHEN paragraphs > 0 AND with_ids / paragraphs < 0.5 THEN 'Citation density too low: ' || printf('%.2f', with_ids / paragraphs) || ' (' || with_ids || '/' || paragraphs || ' paragraphs) (need >= 0.50)' END)"""


@query(
    "citations_of_texts",
    f"""WITH {TEXT_ANSWERS} SELECT document_id AS question_id, array_to_string(cited, ',') AS cited, CASE WHEN ghost THEN 'ghost_1' ELSE '' END AS invented, array_to_string(unused, ',') AS unused, {_ERRORS} AS errors, {_ERRORS} = '' AS valid,
CAST(paragraphs AS INT) AS paragraphs, CAST(with_ids AS INT) AS with_ids, numbered, CAST(len(cited) AS INT) AS citation_count, 1 AS unique_titles, CAST(least(len(cited), 1) AS INT) AS unique_cited_titles, CAST(n AS INT) AS opened_count FROM tv""",
)
def citations_of_texts(spark, sf_dir):
    """Found, numbered, checked and counted citations of answers that consist of whole chunks."""
    ids = F.transform("opened", lambda o: o["chunk_id"])
    made = text_answers(spark, sf_dir).withColumn("v", citations.validate(F.col("answer_text"), ids, citations.STRICT)).withColumn("citations", citations.extract_citations(F.col("answer_text"), ids))
    joined = lambda c, by=",": F.array_join(f"v.{c}", by)
    checked = F.struct(
        joined("cited_ids").alias("cited"), joined("hallucinated_ids").alias("invented"), joined("uncited_opened_ids").alias("unused"), joined("errors", "; ").alias("errors"), F.col("v.valid").alias("valid"),
        F.col("v.paragraph_count").alias("paragraphs"), F.col("v.paragraphs_with_citations").alias("with_ids"), citations.numberize(F.col("answer_text"), F.col("opened"))[0].alias("numbered"),
    )
    runs_ = evaluation.results_to_runs(made.withColumn("checked", checked), "checked")  # measured as they pass: no second reading, no join
    return evaluation.compute_all_measures(runs_, "question_id", "checked").select("question_id", "checked.*", "citation_count", "unique_titles", "unique_cited_titles", "opened_count")


@query(
    "reference_list",
    f"""WITH {ANSWERS} SELECT doc_id AS question_id, CAST(o AS INT) AS ordinal, CASE WHEN o < 3 THEN 'cited' WHEN o = 3 THEN 'opened' ELSE 'web' END AS kind, CASE o WHEN 1 THEN c || 'b' WHEN 2 THEN c || 'a' WHEN 3 THEN c || 'c' ELSE 'http://x/' || doc_id END AS ref FROM a, unnest([1, 2, 3, 4]) AS t(o)""",
)
def reference_list(spark, sf_dir):
    ids = F.transform("opened", lambda o: o["chunk_id"])
    found = citations.find_bracket_ids(F.col("answer_text"))
    rows = answers(spark, sf_dir).select("question_id", F.filter(found, lambda x: F.array_contains(ids, x)).alias("cited"), ids.alias("opened_ids"), "urls")
    return evaluation.reference_list(rows)


@query(
    "evidence_block",
    f"""WITH {ANSWERS}, x AS (SELECT a.*, coalesce(text, '') AS h FROM a JOIN documents USING (doc_id))
SELECT doc_id AS question_id, '--- Evidence 1: [' || c || 'a] T' || t || 'a ---' || chr(10) || h || chr(10) || chr(10) || '--- Evidence 2: [' || c || 'b] T' || t || 'b ---' || chr(10) || h || chr(10) || chr(10) || '--- Evidence 3: [' || c || 'c] T' || t || ' ---' || chr(10) || h AS evidence,
CASE WHEN timed THEN '--- TIMELINE (for reference while writing your answer) ---' || chr(10) || '• 1900: a|b  [' || c || 'a, zz]' || chr(10) || '• 1901: c  [no source]' || chr(10) ELSE '' END AS timeline FROM x""",
)
def evidence_block(spark, sf_dir):
    timeline = F.coalesce(F.col("timeline"), F.array().cast(evaluation.TIMELINE))
    return answers(spark, sf_dir).select("question_id", prompts.evidence_block(F.col("opened")).alias("evidence"), prompts.timeline_section(timeline).alias("timeline"))


TEMPLATE = "Question: {question}\nAnswer so far: {answer_text}\nReply:"


@query("build_prompts", f"WITH {ANSWERS} SELECT doc_id AS question_id, 'Question: ' || source || chr(10) || 'Answer so far: ' || CAST(doc_id AS VARCHAR) || chr(10) || 'Reply:' AS prompt, 'v-' || sha256('{TEMPLATE}')[1:8] AS prompt_version FROM documents".replace("\n", "' || chr(10) || '"))
def build_prompts(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("answer_text", F.col("question_id").cast("string"))
    return prompts.build_prompts(rows, TEMPLATE).select("question_id", "prompt", "prompt_version")


@query(
    "prompt_meta",
    f"WITH {ANSWERS} SELECT doc_id AS question_id, 3 AS evidence_count, CASE WHEN timed THEN 2 ELSE 0 END AS timeline_count, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE len(string_split(coalesce(text, ''), chr(10))) END AS chat_turns, coalesce(text, '') <> '' AS has_summary FROM a JOIN documents USING (doc_id)",
)
def prompt_meta(spark, sf_dir):
    """Lines of the document stand for chat turns, absent for some; the document is the summary."""
    lines = F.when(F.col("doc_id") % 5 > 0, F.split(F.coalesce("text", F.lit("")), "\n"))
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), lines.alias("chat"), F.col("text").alias("summary"))
    rows = answers(spark, sf_dir).drop("chat", "summary").join(texts, "question_id")
    return rows.select("question_id", prompts.prompt_meta(*map(F.col, ("opened", "timeline", "chat", "summary"))).alias("m")).select("question_id", "m.*")


@query("web_and_sub_answer_blocks", "SELECT page_id, '[Web 1] ' || url || chr(10) || 'URL: ' || url || chr(10) || html AS web, '[Part 1] ' || url || chr(10) || '(no answer)' || chr(10) || chr(10) || '[Part 2] Sub-question 2' || chr(10) || 'x' AS parts FROM pages")
def web_and_sub_answer_blocks(spark, sf_dir):
    web = F.array(F.struct(F.col("url").alias("title"), F.col("url").alias("url"), F.col("html").alias("snippet")))
    none = F.lit(None).cast("string")
    parts = F.array(F.struct(F.col("url").alias("question"), none.alias("answer_text")), F.struct(none.alias("question"), F.lit("x").alias("answer_text")))
    return read(spark, sf_dir, "pages").select("page_id", prompts.web_results_block(web).alias("web"), prompts.sub_answers_block(parts).alias("parts"))


@query("recent_turns", "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def recent_turns(spark, sf_dir):
    return conversations.recent_turns(read(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role", "text")


@query("evicted_turns", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || substr(coalesce(text, ''), 1, 300), chr(10) ORDER BY turn) AS evicted FROM r WHERE n > 4 AND b IN (3, 4) GROUP BY conv_id")
def evicted_turns(spark, sf_dir):
    return conversations.evicted_turns(read(spark, sf_dir, "conversations"), 1)


@query("conversation_context", "WITH r AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) SELECT conv_id, '--- CONVERSATION CONTEXT ---' || chr(10) || 'Recent conversation:' || chr(10) || string_agg(upper(role[1]) || lower(role[2:]) || ': ' || CASE WHEN role = 'assistant' AND length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE coalesce(text, '') END, chr(10) ORDER BY turn) || chr(10) AS context FROM r GROUP BY conv_id")
def conversation_context(spark, sf_dir):
    return conversations.conversation_context(read(spark, sf_dir, "conversations"), max_turns=4)


@query("message_tokens", "SELECT conv_id, CAST(sum(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END + 4) + 3 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def message_tokens(spark, sf_dir):
    return conversations.message_tokens(read(spark, sf_dir, "conversations"))


def runs(spark, sf_dir: str) -> DataFrame:
    made = answers(spark, sf_dir)
    ids = F.transform("opened", lambda o: o["chunk_id"])
    return evaluation.results_to_runs(made.withColumn("citations", citations.extract_citations(F.col("answer_text"), ids)))


RUNS = f"{ANSWERS}, m AS (SELECT doc_id AS question_id, c, t, 2 AS citation_count, 3 AS unique_titles, 2 AS unique_cited_titles, doc_id / 8 AS ms, CASE WHEN timed THEN 2 ELSE 0 END AS timeline_item_count, failed FROM a)"


@query("compute_all_measures", f"WITH {RUNS} SELECT question_id, citation_count, unique_titles, unique_cited_titles, 'T' || t || ',T' || t || 'a,T' || t || 'b' AS title_list, ms AS model_latency_ms, 0 AS retrieved_count, 3 AS opened_count, timeline_item_count, timeline_item_count AS timeline_cited_chunks, CASE WHEN timeline_item_count > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS avg_citations_per_event FROM m")
def compute_all_measures(spark, sf_dir):
    made = evaluation.compute_all_measures(runs(spark, sf_dir), "question_id").withColumn("title_list", F.array_join("title_list", ","))
    return made.select("question_id", "citation_count", "unique_titles", "unique_cited_titles", "title_list", "model_latency_ms", "retrieved_count", "opened_count", "timeline_item_count", "timeline_cited_chunks", "avg_citations_per_event")


@query("evaluation_summary", f"WITH {RUNS} SELECT round(avg(CASE WHEN failed THEN 0 ELSE citation_count END), 6) AS avg_citations, round(avg(CASE WHEN failed THEN 0 ELSE unique_cited_titles END), 6) AS avg_sources, round(avg(CASE WHEN failed THEN 0 ELSE timeline_item_count END), 6) AS avg_timeline, count(*) FILTER (failed) AS errors, count(*) AS questions FROM m")
def evaluation_summary(spark, sf_dir):
    made = evaluation.compute_all_measures(runs(spark, sf_dir), "question_id", "error")
    empty = {c: F.when(F.col("error").isNull(), F.col(c)) for c in ("citation_count", "unique_cited_titles", "timeline_item_count")}
    summed = evaluation.evaluation_summary(made.withColumns(empty).withColumn("has_metrics", F.lit(True)))
    return summed.withColumns({c: F.round(c, 6) for c in ("avg_citations", "avg_sources", "avg_timeline")})


@query(
    "summary_lines",
    f"""WITH {RUNS} SELECT row_number() OVER (ORDER BY question_id) AS number, '| ' || row_number() OVER (ORDER BY question_id) || ' | ' || substr(source, 1, 60) || ' | ' || CASE WHEN failed THEN '— | — | —' ELSE '2 | 2 | ' || timeline_item_count END || ' | 0 | ' || CASE WHEN failed THEN 'Yes' ELSE '—' END || ' |' AS line FROM m JOIN documents ON doc_id = question_id""",
)
def summary_lines(spark, sf_dir):
    made = evaluation.compute_all_measures(runs(spark, sf_dir), "question_id", "question", "error")
    empty = {c: F.when(F.col("error").isNull(), F.col(c)) for c in ("citation_count", "unique_cited_titles", "timeline_item_count")}
    return evaluation.summary_lines(made.withColumns(empty))


@query("sources_used", f"WITH {RUNS} SELECT question_id, CAST(i AS INT) AS pos, 'T' || t || ['a', 'b', ''][i + 1] AS title, c || ['a', 'b', 'c'][i + 1] AS chunk_ids FROM m, unnest([0, 1, 2]) AS u(i)")
def sources_used(spark, sf_dir):
    return evaluation.sources_used(runs(spark, sf_dir)).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


_REPORT = r"""
WITH {ANSWERS}, x AS (SELECT a.*, source, doc_id / 8 AS ms FROM a JOIN documents USING (doc_id))
SELECT doc_id AS question_id, '# Evaluation Report: run\nGenerated: 2024-01-01\n\n## Question\n**Q:** ' || source || '\n\n## Answer\nFirst [' || c || 'b][' || c || 'a] and [' || c || 'b].'
|| CASE WHEN ghost THEN ' Also [ghost1].' ELSE '' END || CASE WHEN thin THEN '\n\nNothing here.\n\nNor here.' ELSE '' END
|| '\n\n## Citations\n- `' || c || 'a` — T' || t || 'a\n- `' || c || 'b` — T' || t || 'b\n\n## Timeline\n'
|| CASE WHEN timed THEN '\n| Date | Event | Sources |\n|------|-------|---------|\n| 1900 | a\|b | `' || c || 'a`, `zz` |\n| 1901 | c |  |\n' ELSE '*No timeline extracted.*\n' END
|| '\n## Sources Used\n- **T' || t || 'a**: `' || c || 'a`\n- **T' || t || 'b**: `' || c || 'b`\n- **T' || t || '**: `' || c || 'c`\n\n## Metrics\n\n| Metric | Value |\n|--------|-------|\n'
|| '| Citations in answer | 2 |\n| Unique sources cited | 2 |\n| Unique sources opened | 3 |\n| Timeline events | ' || CASE WHEN timed THEN '2' ELSE '0' END || ' |\n| Avg citations per event | ' || CASE WHEN timed THEN '1.0' ELSE '0.0' END
|| ' |\n| Chunks retrieved | 0 |\n| Chunks opened | 3 |\n| Agent steps | 0 |\n| Model latency (ms) | ' || printf('%.1f', ms) || ' |\n' || CASE WHEN failed THEN '\n## Error\n```\nfailed\n```\n' ELSE '' END AS report FROM x
"""


@query("render_reports", _REPORT.strip().replace("\\n", "' || chr(10) || '").replace("{ANSWERS}", ANSWERS))
def render_reports(spark, sf_dir):
    return runs(spark, sf_dir).select("question_id", evaluation.render_report("run", "2024-01-01").alias("report"))


def latency(spark, sf_dir: str) -> DataFrame:
    """events as a latency table."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("component_name"), F.col("value").alias("duration_ms"))


@query("component_stats", "SELECT count(*) AS count, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms, round(avg(value), 6) AS avg_ms FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def component_stats(spark, sf_dir):
    rows = latency(spark, sf_dir)
    first = rows.agg(F.min("component_name").alias("component_name"))
    made = observability.component_stats(rows.join(F.broadcast(first), "component_name"))
    return made.withColumns({c: F.round(c, 6) for c in ("min_ms", "max_ms", "avg_ms")})


@query("component_stats_by_run", "SELECT event_type AS component_name, user_id AS run_id, count(*) AS count, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms, round(avg(value), 6) AS avg_ms FROM events GROUP BY ALL")
def component_stats_by_run(spark, sf_dir):
    made = observability.component_stats_by(latency(spark, sf_dir), "component_name", "run_id")
    return made.withColumns({c: F.round(c, 6) for c in ("min_ms", "max_ms", "avg_ms")})


@query(
    "run_summary",
    """WITH a AS (SELECT user_id AS run_id, count(*) AS component_calls, sum(value) AS d FROM events WHERE event_id % 3 = 0 GROUP BY ALL), b AS (SELECT user_id AS run_id, sum(event_id) AS i, count(*) AS o FROM events WHERE event_id % 3 = 1 GROUP BY ALL), c AS (SELECT user_id AS run_id, count(*) AS n FROM events WHERE event_id % 3 = 2 GROUP BY ALL)
SELECT coalesce(a.run_id, b.run_id, c.run_id) AS run_id, coalesce(component_calls, 0) AS component_calls, round(coalesce(d, 0), 6) AS total_duration_ms, CAST(coalesce(i, 0) AS BIGINT) AS tokens_in, coalesce(o, 0) AS tokens_out, coalesce(n, 0) AS retrieval_calls FROM a FULL JOIN b USING (run_id) FULL JOIN c USING (run_id)""",
)
def run_summary(spark, sf_dir):
    rows = latency(spark, sf_dir)
    tokens = rows.where("id % 3 = 1").select("run_id", F.col("id").alias("tokens_in"), F.lit(1).alias("tokens_out"))
    return observability.run_summary(rows.where("id % 3 = 0"), tokens, rows.where("id % 3 = 2")).withColumn("total_duration_ms", F.round("total_duration_ms", 6))


@query("latest_metrics", "SELECT event_id AS id, user_id AS run_id, event_type AS component_name, value AS duration_ms FROM events ORDER BY event_id DESC LIMIT 10")
def latest_metrics(spark, sf_dir):
    return observability.latest_metrics(latency(spark, sf_dir))


def logs(spark, sf_dir: str) -> DataFrame:
    """events as log events: completed runs, queries and model calls with JSON data."""
    kind = F.when(F.col("event_id") % 3 == 0, "rag_completed").when(F.col("event_id") % 3 == 1, "query").otherwise("model_call")
    n = F.col("event_id").cast("string")
    data = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"question": "q'), n, F.lit('", "retrieved_count": 4, "opened_count": 2, "tokens_in": 5, "tokens_out": '), (F.col("event_id") % 4).cast("string"), F.lit(', "decompose_latency_ms": '), (F.col("event_id") % 2).cast("string"), F.lit('.0, "total_ms": 8.0}')))
    data = data.when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"query": "'), F.repeat(F.col("event_type"), 60), F.lit('", "query_length": 9}'))).otherwise(F.concat(F.lit('{"model_name": "m", "tokens_out": '), n, F.lit(', "duration_ms": 500}')))
    return read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), kind.alias("event_type"), F.lit("INFO").alias("level"), F.format_string("run-%08d", "user_id").alias("run_id"), data.alias("data"))


LOGS = "l AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, format('run-{:08d}', user_id) AS run_id FROM events)"


@query("log_queries", f"WITH {LOGS} SELECT stamp AS timestamp, run_id AS log_run_id, substr(repeat(event_type, 60), 1, 200) AS query, CAST(9 AS BIGINT) AS query_length, CAST(NULL AS VARCHAR) AS query_id FROM l WHERE event_id % 3 = 1")
def log_queries(spark, sf_dir):
    return observability.log_projection(logs(spark, sf_dir), "query")


@query("log_model_calls", f"WITH {LOGS} SELECT stamp AS timestamp, run_id AS log_run_id, 'm' AS model_name, CAST(event_id AS BIGINT) AS tokens_out, 500.0::DOUBLE AS duration_ms FROM l WHERE event_id % 3 = 2")
def log_model_calls(spark, sf_dir):
    return observability.log_projection(logs(spark, sf_dir), "model_call").select("timestamp", "log_run_id", "model_name", "tokens_out", "duration_ms")


@query("runs_from_logs", f"WITH {LOGS} SELECT stamp AS timestamp, run_id, 'rag' AS graph, 'q' || event_id AS question, CAST(event_id % 4 AS BIGINT) AS tokens_out, 8.0::DOUBLE AS total_ms FROM l WHERE event_id % 3 = 0")
def runs_from_logs(spark, sf_dir):
    return observability.runs_from_logs(logs(spark, sf_dir)).select("timestamp", "run_id", "graph", "question", "tokens_out", "total_ms")


@query(
    "metrics_from_runs",
    f"""WITH {LOGS}, c AS (SELECT * FROM l WHERE event_id % 3 = 0) SELECT run_id, 'rag.run' AS item, 8.0::DOUBLE AS value FROM c UNION ALL SELECT run_id, 'rag.decomposer', 1.0 FROM c WHERE event_id % 2 = 1 UNION ALL SELECT run_id, 'tokens_per_second', (event_id % 4) / 0.008 FROM c WHERE event_id % 4 > 0 UNION ALL SELECT run_id, 'q' || event_id, 2 FROM c""",
)
def metrics_from_runs(spark, sf_dir):
    made = observability.metrics_from_runs(observability.runs_from_logs(logs(spark, sf_dir)))
    parts = [
        made["component_latency"].select("run_id", F.col("component_name").alias("item"), F.col("duration_ms").alias("value")),
        made["model_tokens"].select("run_id", F.lit("tokens_per_second").alias("item"), F.col("tokens_per_second").alias("value")),
        made["retrieval_counts"].select("run_id", F.col("query").alias("item"), F.col("final_count").cast("double").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("log_timeline", f"WITH {LOGS} SELECT stamp AS timestamp, 'INFO' AS level, CASE event_id % 3 WHEN 0 THEN 'rag_completed' WHEN 1 THEN 'query' ELSE 'model_call' END AS event_type FROM l WHERE run_id = (SELECT max(run_id) FROM l)")
def log_timeline(spark, sf_dir):
    return observability.log_timeline(logs(spark, sf_dir))
