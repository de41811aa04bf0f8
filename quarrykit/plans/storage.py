"""Registered queries over sources and sinks: tables are written, read back and compared with what they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.operators import chunking, evaluation, observability, store, vector
from quarrykit.sources import mediawiki, tables
from quarrykit.streaming import logs

from . import answers
from .answers import LOGS
from .corpus import COMPARED, FIXED, articles, fixed_chunks, page_xml, read
from .letters import LETTERS, counts_sql, letter_embedder
from .retrieval import _REQUESTS, _requests

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "read_mediawiki_dump",
    """WITH d AS (SELECT concat_ws('/', source, doc_id) AS title, CASE WHEN doc_id % 11 = 0 THEN '1' ELSE '0' END AS ns, CAST(doc_id AS VARCHAR) AS page_id, doc_id % 7 = 0 AS is_redirect, coalesce(text, '') AS raw_text FROM documents)
SELECT split, title, ns, page_id, is_redirect, raw_text FROM d, (VALUES (false), (true)) AS s(split)""",
)
def read_mediawiki_dump(spark, sf_dir):
    """The dump is read by whole files and split at page ends."""
    path = tables.scratch(spark, "dump")
    pages = page_xml(spark, sf_dir).select(F.from_xml("xml", mediawiki.PAGE, {"ignoreSurroundingSpaces": "false"}).alias("p")).select("p.*")
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return mediawiki.read_mediawiki_dump(spark, path).withColumn("split", F.lit(False)).unionByName(mediawiki.read_mediawiki_dump(spark, path, split=True).withColumn("split", F.lit(True))).withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


@query("manifest_round_trip", "SELECT 'articles' AS artifact_type, 'documents' AS source, 'table' AS output, count(*) AS n_articles, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, 'run-1' AS run_id, '2024-01-01T00:00:00' AS created_at FROM documents")
def manifest_round_trip(spark, sf_dir):
    made = articles(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("text_length").alias("c")).first()  # one row
    record = {"artifact_type": "articles", "source": "documents", "output": "table", "counts": {"articles": made["n"], "chars": made["c"]}, "run_id": "run-1", "created_at": "2024-01-01T00:00:00"}
    path = tables.scratch(spark, "manifest")
    mediawiki.write_manifest(spark, record, path)
    counts = {"n_articles": F.col("counts")["articles"], "n_chars": F.col("counts")["chars"]}
    return mediawiki.read_manifest(spark, path).withColumns(counts).drop("counts")


@query("chunk_table_round_trip", f"WITH {FIXED} SELECT chunk_id, document_id, title, text, start_char, end_char, text_length FROM chunks")
def chunk_table_round_trip(spark, sf_dir):
    """First chunks overwrite, all others are appended; some columns are read back."""
    chunks, path = fixed_chunks(spark, sf_dir), tables.scratch(spark, "chunks")
    tables.write_chunks(chunks.where("start_char = 0"), path)
    tables.write_chunks(chunks.where("start_char > 0"), path, "append")
    return tables.read_chunks(spark, path, ["chunk_id", "document_id", "title", "text", "start_char", "end_char", "text_length"])


@query("chunk_articles", f"{COMPARED.replace('pchunks AS', 'pchunks AS MATERIALIZED')} SELECT chunk_id, chunker_name, chunker_settings, text_length FROM both_")
def chunk_articles(spark, sf_dir):
    plain = articles(spark, sf_dir)
    wide = plain.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    made = chunking.chunk_articles(plain, "fixed_size", chunk_size=1000, overlap=200).unionByName(chunking.chunk_articles(wide, "paragraph_aware", target_size=1000))
    return made.select("chunk_id", "chunker_name", "chunker_settings", "text_length")


@query("count_chunks", f"WITH {FIXED}, r AS ({_REQUESTS}) SELECT (SELECT count(DISTINCT chunk_id) FROM chunks) AS n_chunks, (SELECT count(DISTINCT chunk_id) FROM r WHERE chunk_id IN (SELECT chunk_id FROM chunks)) AS n_requested")
def count_chunks(spark, sf_dir):
    chunks = fixed_chunks(spark, sf_dir)
    asked = store.chunks_contain(_requests(spark, sf_dir), chunks).where("found")
    return store.count_chunks(chunks).withColumnRenamed("count", "n_chunks").join(store.count_chunks(asked).withColumnRenamed("count", "n_requested"))


_SHOWN = "array_to_string(list_append(v, CAST(list_sum(list_transform(v, lambda y: y * y)) AS BIGINT)), ' ')"


def _shown(rows: DataFrame) -> DataFrame:
    """A unit vector by its ratios to the last number, which are the counts, and the square of its former length."""
    last = F.element_at("vector", -1).cast("double")
    whole = lambda x: F.round(x).cast("long")
    counts = F.transform("vector", lambda x: whole(x.cast("double") / last))
    return rows.withColumn("vector", F.array_join(F.concat(counts, F.array(whole(1 / (last * last)))).cast("array<string>"), " "))


@query("embed_texts", f"WITH {FIXED}, e AS (SELECT chunk_id, {counts_sql('text')} AS v FROM chunks) SELECT chunk_id, {_SHOWN} AS vector FROM e")
def embed_texts(spark, sf_dir):
    made = vector.embed_texts(fixed_chunks(spark, sf_dir).select("chunk_id", "text"), letter_embedder)
    return _shown(made.select("chunk_id", "vector"))


@query("embed_queries", f"WITH q AS (SELECT item_id AS query_id, 'query: ' || coalesce(text, '') AS t FROM benchmark), e AS (SELECT query_id, {counts_sql('t')} AS v FROM q) SELECT query_id, {_SHOWN} AS vector FROM e")
def embed_queries(spark, sf_dir):
    """With the prefix of an E5-like model."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _shown(vector.embed_queries(asked, letter_embedder, model="multilingual-e5-base").select("query_id", "vector"))


@query("build_vector_index", f"WITH {FIXED} SELECT count(*) AS num_chunks, {len(LETTERS) + 1} AS embedding_dim, count(*) AS rows_written FROM chunks")
def build_vector_index(spark, sf_dir):
    return vector.build_vector_index(fixed_chunks(spark, sf_dir), letter_embedder, tables.scratch(spark, "index"))


@query("chunk_index_append", f"WITH {FIXED}, e AS (SELECT chunk_id, document_id, title, section, {counts_sql('text')} AS v FROM chunks) SELECT chunk_id, document_id, title, section, {_SHOWN} AS vector FROM e")
def chunk_index_append(spark, sf_dir):
    """An index that is written in two steps, the second appended."""
    path = tables.scratch(spark, "index")
    chunks = fixed_chunks(spark, sf_dir)
    for mode, part in (("overwrite", chunks.where("start_char = 0")), ("append", chunks.where("start_char > 0"))):
        vector.write_chunk_index(vector.embed_texts(part, letter_embedder), path, mode)
    return _shown(spark.read.parquet(path).drop("text"))


@query("chunk_index_upsert", f"WITH {FIXED}, e AS (SELECT chunk_id, document_id, title, section, {counts_sql('text')} AS v FROM chunks) SELECT chunk_id, document_id, title, section, {_SHOWN} AS vector FROM e")
def chunk_index_upsert(spark, sf_dir):
    """First chunks with a wrong title, then all chunks, then the first ones again, as a retried job does."""
    path, chunks = tables.scratch(spark, "index"), fixed_chunks(spark, sf_dir)
    first = chunks.where("start_char = 0")
    for part in (first.withColumn("title", F.lit("wrong")), chunks, first):
        vector.write_chunk_index(vector.embed_texts(part, letter_embedder), path, "upsert")
    return _shown(tables.read_upserted(spark, path).drop("text"))


@query(
    "chunk_store_lookup",
    f"WITH {FIXED}, r AS ({_REQUESTS}) SELECT req_id, pos, chunk_id, document_id, title, section, text, start_char, end_char, CAST(length(text) // 4 AS BIGINT) AS token_count FROM r JOIN chunks USING (chunk_id)",
)
def chunk_store_lookup(spark, sf_dir):
    """Lookups in a bucketed table of all chunks."""
    path = tables.scratch(spark, "store")
    stored = store.write_chunk_store(fixed_chunks(spark, sf_dir), path.rpartition("/")[2].replace("-", "_"), path, 8)
    return store.get_many_chunks(_requests(spark, sf_dir), stored)


@query("run_log_round_trip", f"WITH {LOGS} SELECT stamp AS timestamp, CASE event_id % 3 WHEN 0 THEN 'rag_completed' WHEN 1 THEN 'query' ELSE 'model_call' END AS event_type, 'INFO' AS level, run_id FROM l")
def run_log_round_trip(spark, sf_dir):
    path = tables.scratch(spark, "logs")
    tables.write_run_logs(answers.logs(spark, sf_dir), path)
    return tables.read_run_logs(spark, path).select("timestamp", "event_type", "level", "run_id")


@query("incremental_logs", f"WITH {LOGS} SELECT stamp AS timestamp, CASE event_id % 3 WHEN 0 THEN 'rag_completed' WHEN 1 THEN 'query' ELSE 'model_call' END AS event_type, 'INFO' AS level, run_id FROM l")
def incremental_logs(spark, sf_dir):
    """Log files that come in two times; a third call finds nothing new."""
    path, table, checkpoint = (tables.scratch(spark, x) for x in ("logs", "log_table", "log_checkpoint"))
    rows = answers.logs(spark, sf_dir)
    half = F.pmod(F.xxhash64("timestamp", "run_id"), F.lit(2))
    for part in (0, 1, None):
        if part is not None:
            tables.write_run_logs(rows.where(half == part), f"{path}/{part}")
        made = logs.take_up_logs(spark, f"{path}/*", table, checkpoint)
    return made.select("timestamp", "event_type", "level", "run_id")


@query("question_round_trip", "SELECT 'q' || item_id AS id, text AS question, 'topic' AS topic, CAST(NULL AS VARCHAR) AS expected_date_range FROM benchmark WHERE text <> ''")
def question_round_trip(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").where("text <> ''").select(F.concat(F.lit("q"), F.col("item_id")).alias("id"), F.col("text").alias("question"), F.lit("topic").alias("topic"), F.lit(None).cast("string").alias("expected_date_range"))
    path = tables.scratch(spark, "questions")
    tables.save_questions(rows, path)
    return tables.load_questions(spark, path)


@query("eval_result_round_trip", f"WITH {answers.RUNS} SELECT question_id, CAST(citation_count AS BIGINT) AS citation_count, CAST(unique_titles AS BIGINT) AS unique_titles, CAST(timeline_item_count AS BIGINT) AS timeline_item_count, failed FROM m")
def eval_result_round_trip(spark, sf_dir):
    runs, path = answers.runs(spark, sf_dir), tables.scratch(spark, "results")
    named = runs if "question" in runs.columns else runs.withColumn("question", F.lit(""))
    evaluation.write_eval_results(named, evaluation.compute_all_measures(runs, "question_id"), path)
    kind = "question_id long, error string, metrics struct<citation_count:bigint,unique_titles:bigint,timeline_item_count:bigint>"
    return spark.read.schema(kind).json(path).select("question_id", "metrics.*", F.col("error").isNotNull().alias("failed"))


@query(
    "metric_round_trip",
    "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS run_id, substr(repeat(event_type, 60), 1, 200) AS query, event_id % 5 AS tokens_out, value AS duration_ms, round(CASE WHEN value > 0 THEN (event_id % 5) / (value / 1000) ELSE 0 END, 6) AS tokens_per_second FROM events",
)
def metric_round_trip(spark, sf_dir):
    """Appends to one table, one of them twice; absent runs become `unknown`, queries are cut."""
    i, path = F.col("event_id"), tables.scratch(spark, "metrics")
    rows = read(spark, sf_dir, "events").select(i.alias("id"), F.when(i % 2 == 1, F.col("user_id").cast("string")).alias("run_id"), F.repeat("event_type", 60).alias("query"), (i % 5).alias("tokens_out"), F.col("value").alias("duration_ms"))
    for rest in (0, 1, 0):
        observability.append_metrics(rows.where(F.col("id") % 2 == rest), path, ["id"])
    return tables.read_upserted(spark, path).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


#: One event of each further type: its data by SQL and the fields that its view shows.
_EVENTS = {
    "retrieval": ("'{\"query\": \"' || repeat(event_type, 40) || '\", \"num_results\": ' || event_id || ', \"retrieval_method\": \"bm25\", \"duration_ms\": 2.5}'", "substr(repeat(event_type, 40), 1, 100) || '|' || event_id || '|bm25|2.5'", ["query", "num_results", "retrieval_method", "duration_ms"]),
    "component_started": ("'{\"component_name\": \"c' || event_id || '\", \"component_type\": \"tool\", \"params\": \"p\"}'", "'c' || event_id || '|tool|p'", ["component_name", "component_type", "params"]),
    "component_finished": ("'{\"component_name\": \"c' || event_id || '\", \"component_type\": \"tool\", \"duration_ms\": 1.5, \"result\": \"ok\"}'", "'c' || event_id || '|tool|1.5|ok'", ["component_name", "component_type", "duration_ms", "result"]),
    "error": ("'{\"error_type\": \"E\", \"error_message\": \"' || event_type || '\", \"context\": \"x\"}'", "'E|' || event_type || '|x'", ["error_type", "error_message", "context"]),
    "run_started": ("'{\"run_id\": \"r' || event_id || '\", \"run_type\": \"rag\", \"config\": \"{}\"}'", "'r' || event_id || '|rag|{}'", ["run_id", "run_type", "config"]),
}


@query("log_other_events", "WITH k AS (SELECT * FROM events, (VALUES " + ", ".join(f"('{k}')" for k in _EVENTS) + ") AS t(kind)) SELECT event_id, kind, CASE kind " + " ".join(f"WHEN '{k}' THEN {shown}" for k, (_, shown, _) in _EVENTS.items()) + " END AS fields FROM k")
def log_other_events(spark, sf_dir):
    """Views of retrievals, components, errors and started runs."""
    rows, made = read(spark, sf_dir, "events"), None
    for kind, (data, _, fields) in _EVENTS.items():
        logs = rows.select(F.col("event_id").cast("string").alias("timestamp"), F.lit(kind).alias("event_type"), F.lit("r").alias("run_id"), F.expr(data).alias("data"))
        view = observability.log_projection(logs, kind).select(F.col("timestamp").cast("long").alias("event_id"), F.lit(kind).alias("kind"), F.concat_ws("|", *(F.col(f).cast("string") for f in fields)).alias("fields"))
        made = view if made is None else made.unionByName(view)
    return made
