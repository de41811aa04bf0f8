"""Profiles of articles and chunk indexes. `exact=False` trades exact quantiles and distinct counts for sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import quantiles

#: Fixed: leftover markup that the audit looks for.
LEFTOVERS = [("[[..]] wikilinks", "\\[\\["), ("{{..}} templates", "\\{\\{"), ("<ref> tags", "<ref"), ("''' bold", "'''"), ("Category:", "Category:"), ("{| table start", "\\{\\|")]


def _with_quantiles(rows: DataFrame, c: str, shares: dict[str, float], exact: bool, made: list[Column], order: list[str]) -> DataFrame:
    """One row of aggregates and quantiles; exact ones are found by counts of values, without a list of them."""
    if not exact:
        return rows.agg(*made, *(F.percentile_approx(c, q, 10000).cast("double").alias(n) for n, q in shares.items())).select(*order)
    return rows.agg(*made).join(quantiles(rows, c, shares)).select(*order)  # one row each


def length_profile(articles: DataFrame, c: str = "text_length", exact: bool = True) -> DataFrame:
    made = [f(c).alias(n) for n, f in (("count", F.count), ("sum", F.sum), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return _with_quantiles(articles, c, shares, exact, made, ["count", "sum", "mean", "std", "min", *shares, "max"])


def length_histogram(articles: DataFrame, c: str = "text_length", cap: int = 20000, bins: int = 80) -> DataFrame:
    """bin, low, n: equal-width bins from the least to the greatest capped value; empty bins are left out."""
    capped = articles.select(F.least(F.col(c), F.lit(cap)).cast("double").alias("v"))
    ends = capped.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    rows = capped.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin"), "lo", width.alias("w")).agg(F.count("*").alias("n"))
    return rows.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), "n")


def shortest_longest(articles: DataFrame, n: int = 5, preview: int = 80) -> DataFrame:
    """kind, page_id, title, text_length, preview of the n shortest and n longest articles; ties by page_id."""
    rows = articles.select("page_id", "title", "text_length", F.substring("text", 1, preview).alias("preview"))
    short = rows.orderBy("text_length", "page_id").limit(n).withColumn("kind", F.lit("shortest"))
    return short.unionByName(rows.orderBy(F.desc("text_length"), "page_id").limit(n).withColumn("kind", F.lit("longest")))


def find_titles(articles: DataFrame, pattern: str) -> DataFrame:
    return articles.where(F.contains(F.lower("title"), F.lit(pattern.lower()))).select("page_id", "title")


def markup_audit(articles: DataFrame, sample: int | None = None) -> DataFrame:
    """label, count, percent, status per kind of leftover; `sample` takes the rows with the smallest hashes of page_id."""
    rows = articles.select("page_id", "text")
    if sample is not None:
        rows = rows.orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    counts = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col("text").rlike(p)).alias(f"c{i}") for i, (_, p) in enumerate(LEFTOVERS)))
    items = F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"c{i}").alias("count")) for i, (label, _) in enumerate(LEFTOVERS)))
    made = counts.select("n", F.explode(items).alias("x")).select("n", "x.*")
    percent = F.round(100 * F.col("count") / F.greatest("n", F.lit(1)), 4)
    return made.select("label", "count", percent.alias("percent"), F.when(percent < 5, "ok").otherwise("REVIEW").alias("status"))


def index_profile(index: DataFrame, exact: bool = True) -> DataFrame:
    distinct = F.count_distinct if exact else F.approx_count_distinct
    rows = index.withColumn("_n", F.length("text"))
    size = [F.max(F.size("vector")).alias("vector_size")] if "vector" in index.columns else []
    made = [
        F.count("*").alias("rows"), distinct("title").alias("titles"), distinct("document_id").alias("documents"), *size,
        F.min("_n").alias("min_len"), F.avg("_n").alias("mean_len"), F.max("_n").alias("max_len"),
    ]
    order = ["rows", "titles", "documents", *(["vector_size"] if size else []), "min_len", "median_len", "mean_len", "max_len"]
    return _with_quantiles(rows, "_n", {"median_len": 0.5}, exact, made, order)


def top_chunked_titles(chunks: DataFrame, n: int = 10) -> DataFrame:
    return chunks.groupBy("title").agg(F.count("*").alias("n_chunks")).orderBy(F.desc("n_chunks"), "title").limit(n)
