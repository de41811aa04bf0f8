"""Log events to typed views, metric tables and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.sources.tables import upsert

#: Typed fields of each event's data.
EVENTS = {
    "query": "query string, query_length long, query_id string",
    "retrieval": "query string, num_results long, retrieval_method string, duration_ms double",
    "model_call": "model_name string, tokens_in long, tokens_out long, duration_ms double, tokens_per_second double",
    "component_started": "component_name string, component_type string, params string",
    "component_finished": "component_name string, component_type string, duration_ms double, result string",
    "error": "error_type string, error_message string, context string",
    "run_started": "run_id string, run_type string, config string",
}
CUTS = {"query": 200, "retrieval": 100}
COMPLETED = (
    "question string, rewritten_query string, answer_length long, citation_count long, retrieved_count long, opened_count long, timeline_count long, chat_turns long, tokens_in long, "
    "tokens_out long, is_decomposed boolean, sub_question_count long, decompose_latency_ms double, error string, total_ms double"
)


def log_projection(logs: DataFrame, event_type: str) -> DataFrame:
    """timestamp, run_id and the typed fields of one event type; `logs.data` is a JSON string."""
    made = logs.where(F.col("event_type") == event_type).select("timestamp", F.col("run_id").alias("log_run_id"), F.from_json("data", EVENTS[event_type]).alias("d")).select("timestamp", "log_run_id", "d.*")
    return made.withColumn("query", F.substring("query", 1, CUTS[event_type])) if event_type in CUTS else made


def runs_from_logs(logs: DataFrame) -> DataFrame:
    """One row per `<graph>_completed` event."""
    made = logs.where(F.col("event_type").endswith("_completed")).select("timestamp", "run_id", F.regexp_replace("event_type", "_completed$", "").alias("graph"), F.from_json("data", COMPLETED).alias("d"))
    return made.select("timestamp", "run_id", "graph", "d.*")


def tokens_per_second(tokens: str = "tokens_out", ms: str = "duration_ms"):
    return F.when(F.col(ms) > 0, F.col(tokens) / (F.col(ms) / 1000)).otherwise(0.0)


def metrics_from_runs(runs: DataFrame) -> dict[str, DataFrame]:
    """component_latency, model_tokens and retrieval_counts rows of completed runs."""
    base = ["timestamp", F.coalesce("run_id", F.lit("unknown")).alias("run_id")]
    latency = lambda rows, suffix, kind, ms: rows.select(*base, F.concat("graph", F.lit(suffix)).alias("component_name"), F.lit(kind).alias("component_type"), F.col(ms).alias("duration_ms"), F.lit("success").alias("status"))
    return {
        "component_latency": latency(runs, ".run", "graph", "total_ms").unionByName(latency(runs.where("decompose_latency_ms > 0"), ".decomposer", "decomposer", "decompose_latency_ms")),
        "model_tokens": runs.where("tokens_out > 0").select(*base, "tokens_in", "tokens_out", F.col("total_ms").alias("duration_ms"), tokens_per_second(ms="total_ms").alias("tokens_per_second")),
        "retrieval_counts": runs.select(*base, F.substring(F.coalesce(F.nullif("rewritten_query", F.lit("")), "question"), 1, 200).alias("query"), F.col("retrieved_count").alias("keyword_candidates"), F.col("retrieved_count").alias("vector_candidates"), F.col("retrieved_count").alias("reranked"), F.col("opened_count").alias("final_count"), F.col("total_ms").alias("duration_ms")),
    }


def append_metrics(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Appends rows of a metric table with defaults: run_id `unknown`, query cut to 200, tokens per second filled.

    With `keys`, which name a measurement, a repeated call adds nothing, and a row that has changed replaces the former.
    """
    if "run_id" in rows.columns:
        rows = rows.withColumn("run_id", F.coalesce("run_id", F.lit("unknown")))
    if "query" in rows.columns:
        rows = rows.withColumn("query", F.substring("query", 1, 200))
    if {"tokens_out", "duration_ms"} <= set(rows.columns):
        rows = rows.withColumn("tokens_per_second", tokens_per_second())
    if keys:
        upsert(rows, path, keys)
    else:
        rows.write.mode("append").parquet(path)


def component_stats(latency: DataFrame, component: str | None = None, run_id: str | None = None) -> DataFrame:
    """One row: count, min, max, avg of duration_ms; zeros where there is none."""
    if component is not None:
        latency = latency.where(F.col("component_name") == component)
    if run_id is not None:
        latency = latency.where(F.col("run_id") == run_id)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return latency.agg(F.count("*").alias("count"), zero(F.min("duration_ms")).alias("min_ms"), zero(F.max("duration_ms")).alias("max_ms"), zero(F.avg("duration_ms")).alias("avg_ms"))


def component_stats_by(latency: DataFrame, *keys: str) -> DataFrame:
    return latency.groupBy(*keys).agg(F.count("*").alias("count"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.avg("duration_ms").alias("avg_ms"))


def run_summary(latency: DataFrame, tokens: DataFrame, retrieval: DataFrame) -> DataFrame:
    """Per run_id calls, total duration, tokens and retrievals; each table is summed before the joins."""
    a = latency.groupBy("run_id").agg(F.count("*").alias("component_calls"), F.sum("duration_ms").alias("total_duration_ms"))
    b = tokens.groupBy("run_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    c = retrieval.groupBy("run_id").agg(F.count("*").alias("retrieval_calls"))
    return a.join(b, "run_id", "full_outer").join(c, "run_id", "full_outer").fillna(0)


def latest_metrics(table: DataFrame, n: int = 10) -> DataFrame:
    return table.orderBy(F.desc("id")).limit(n)


def log_timeline(logs: DataFrame) -> DataFrame:
    """timestamp, level, event_type of the newest run (run ids start with their time), in time order."""
    newest = logs.agg(F.max("run_id").alias("run_id"))
    return logs.join(F.broadcast(newest), "run_id").select("timestamp", "level", "event_type").orderBy("timestamp")
