"""Measures of finished runs, summaries and Markdown reports.

A run row has question, step, error, answer_text, citations, retrieved, opened, timeline, tokens_in, tokens_out and
model_latency_ms; lists are arrays of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

STRINGS = "array<string>"
RETRIEVED = "array<struct<chunk_id:string,score:double,title:string,snippet:string>>"
OPENED = "array<struct<chunk_id:string,document_id:string,title:string,section:string,text:string>>"
TIMELINE = "array<struct<date:string,event:string,supporting_chunk_ids:array<string>>>"
DEFAULTS = [("step", "int", 0), ("answer_text", "string", ""), ("tokens_in", "long", 0), ("tokens_out", "long", 0), ("model_latency_ms", "double", 0.0)]
LISTS = [("citations", STRINGS), ("retrieved", RETRIEVED), ("opened", OPENED), ("timeline", TIMELINE)]


def results_to_runs(results: DataFrame, *also: str) -> DataFrame:
    """Run rows from results whose fields may be absent or null. The columns `also` stay as they are."""
    have = set(results.columns)
    get = lambda n, kind: F.col(n).cast(kind) if n in have else F.lit(None).cast(kind)
    keep = [c for c in results.columns if c in ("question_id", "question", "topic", *also)]
    lists = [F.coalesce(get(n, kind), F.array().cast(kind)).alias(n) for n, kind in LISTS]
    scalars = [F.coalesce(get(n, kind), F.lit(v).cast(kind)).alias(n) for n, kind, v in DEFAULTS]
    return results.select(*keep, *lists, *scalars, get("error", "string").alias("error"), F.lit(True).alias("done"))


def _titles(opened: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(opened, lambda o: o["title"]), lambda t: t.isNotNull() & (t != "")))


def measures() -> dict[str, Column]:
    """All measures of one run row, by name."""
    cited = F.filter("opened", lambda o: F.array_contains("citations", o["chunk_id"]))
    n = F.size("timeline")
    total = F.aggregate("timeline", F.lit(0), lambda s, t: s + F.size(t["supporting_chunk_ids"]))
    return {
        "citation_count": F.size("citations"),
        "unique_titles": F.size(_titles(F.col("opened"))),
        "unique_cited_titles": F.size(_titles(cited)),
        "title_list": F.array_sort(_titles(F.col("opened"))),
        "model_latency_ms": F.col("model_latency_ms"),
        "total_steps": F.col("step"),
        "retrieved_count": F.size("retrieved"),
        "opened_count": F.size("opened"),
        "timeline_count": n,
        "timeline_item_count": n,
        "timeline_cited_chunks": F.when(n > 0, total).otherwise(0),
        "avg_citations_per_event": F.when(n > 0, F.bround(total / n, 2)).otherwise(0.0),
    }


def compute_all_measures(runs: DataFrame, *keys: str) -> DataFrame:
    made = runs.select(*keys, *(c.alias(n) for n, c in measures().items()))
    return made.withColumn("total_latency_ms", F.round("model_latency_ms", 1))


def evaluation_summary(measured: DataFrame) -> DataFrame:
    """One row of averages over questions (an absent measure counts as 0), errors and number of questions.

    `measured`: has_metrics, citation_count, unique_cited_titles, timeline_item_count, error.
    """
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("has_metrics"), F.coalesce(F.col(c), F.lit(0)))), F.lit(0.0))
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    return measured.agg(mean("citation_count").alias("avg_citations"), mean("unique_cited_titles").alias("avg_sources"), mean("timeline_item_count").alias("avg_timeline"), F.count_if(failed).alias("errors"), F.count("*").alias("questions"))


def summary_lines(measured: DataFrame) -> DataFrame:
    """number, line of the summary's table, by question_id (one row each)."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    failed = F.when(F.coalesce("error", F.lit("")) != "", "Yes").otherwise("—")
    cells = [F.col("number").cast("string"), F.substring("question", 1, 60), *(value(c) for c in ("citation_count", "unique_cited_titles", "timeline_item_count", "total_steps")), failed]
    return numbered(measured, "question_id").select("number", F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |")).alias("line"))


def sources_used(runs: DataFrame, key: str = "question_id") -> DataFrame:
    """key, pos, title, chunk_ids: titles of opened chunks in first-seen order with all their chunks."""
    rows = runs.select(key, F.posexplode("opened").alias("at", "o")).select(key, "at", "o.title", "o.chunk_id").where(F.coalesce("title", F.lit("")) != "")
    grouped = rows.groupBy(key, "title").agg(F.min("at").alias("pos"), F.array_sort(F.collect_list(F.struct("at", "chunk_id"))).alias("c"))
    return grouped.select(key, "pos", "title", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"))


#: Fixed: measures of a report and their labels; the texts of `render_report` are fixed too.
LABELS = [
    ("citation_count", "Citations in answer"), ("unique_cited_titles", "Unique sources cited"), ("unique_titles", "Unique sources opened"), ("timeline_item_count", "Timeline events"),
    ("avg_citations_per_event", "Avg citations per event"), ("retrieved_count", "Chunks retrieved"), ("opened_count", "Chunks opened"), ("total_steps", "Agent steps"), ("model_latency_ms", "Model latency (ms)"),
]


def render_report(run_id: str, generated: str) -> Column:
    """Markdown of one run row (with question, topic if any, and the run's fields)."""
    code = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    title = lambda i: F.coalesce(F.element_at(F.filter("opened", lambda o: o["chunk_id"] == i), 1)["title"], F.lit(""))
    cites = F.transform("citations", lambda i: F.concat(F.lit("- "), code(i), F.lit(" — "), F.when(F.exists("opened", lambda o: o["chunk_id"] == i), title(i)).otherwise("")))
    events = F.transform("timeline", lambda t: F.concat(F.lit("| "), t["date"], F.lit(" | "), F.replace(t["event"], F.lit("|"), F.lit("\\|")), F.lit(" | "), F.array_join(F.transform(t["supporting_chunk_ids"], code), ", "), F.lit(" |")))
    ids = lambda t: F.array_join(F.transform(F.filter("opened", lambda o: o["title"] == t), lambda o: code(o["chunk_id"])), ", ")
    sources = F.transform(_titles(F.col("opened")), lambda t: F.concat(F.lit("- **"), t, F.lit("**: "), ids(t)))
    values = measures()
    shown = lambda n: F.format_string("%.1f", F.bround(values[n].cast("double"), 1)) if n in ("avg_citations_per_event", "model_latency_ms") else values[n].cast("string")
    table = [F.concat(F.lit(f"| {label} | "), shown(n), F.lit(" |")) for n, label in LABELS]
    block = lambda head, items, none: F.concat(F.lit(f"\n## {head}\n"), F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(none), F.lit("\n"))
    answer = F.when(F.col("answer_text") != "", F.col("answer_text")).otherwise("*No answer generated.*")
    error = F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("\n## Error\n```\n"), F.col("error"), F.lit("\n```\n"))).otherwise("")
    rows = F.concat(F.array(F.lit("\n| Date | Event | Sources |"), F.lit("|------|-------|---------|")), events)
    return F.concat(
        F.lit(f"# Evaluation Report: {run_id}\nGenerated: {generated}\n\n## Question\n**Q:** "), F.col("question"), F.lit("\n\n## Answer\n"), answer, F.lit("\n"),
        block("Citations", cites, "*No citations found in answer.*"), F.when(F.size("timeline") > 0, F.concat(F.lit("\n## Timeline\n"), F.array_join(rows, "\n"), F.lit("\n"))).otherwise("\n## Timeline\n*No timeline extracted.*\n"),
        block("Sources Used", sources, "*No sources opened.*"), F.lit("\n## Metrics\n\n| Metric | Value |\n|--------|-------|\n"), F.array_join(F.array(*table), "\n"), F.lit("\n"), error,
    )


def reference_list(runs: DataFrame, key: str = "question_id") -> DataFrame:
    """key, ordinal, kind (cited, opened, web), ref: cited chunks, then opened but uncited ones, then urls.

    `runs`: key, cited (array of ids in number order), opened_ids, urls.
    """
    def items(kind: str, refs: Column) -> Column:
        return F.transform(refs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref")))

    unused = F.filter("opened_ids", lambda x: ~F.array_contains("cited", x))
    all_ = F.concat(items("cited", F.col("cited")), items("opened", unused), items("web", F.col("urls")))
    return runs.select(key, F.posexplode(all_).alias("ordinal", "r")).select(key, (F.col("ordinal") + 1).alias("ordinal"), "r.kind", "r.ref")


def write_eval_results(runs: DataFrame, measured: DataFrame, path: str, key: str = "question_id") -> None:
    names = list(measures())
    rows = runs.join(measured.select(key, F.struct(*names).alias("metrics")), key)
    rows.select(key, "question", "metrics", "error", "answer_text", "citations", "timeline").write.mode("overwrite").json(path)
