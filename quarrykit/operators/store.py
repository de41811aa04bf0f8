"""Chunk lookups for tables of requests, and packing of chunks into contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.text import snippet, token_count

SEPARATOR = "\n\n---\n\n"


def write_chunk_store(chunks: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """A table of chunks in buckets sorted by chunk_id. Lookups by id read it as it lies: only requests are shuffled."""
    chunks.write.mode("overwrite").bucketBy(buckets, "chunk_id").sortBy("chunk_id").option("path", path).saveAsTable(name)
    return chunks.sparkSession.table(name)


def get_many_chunks(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Full rows for requests (req_id, pos, chunk_id) in requested order: unknown ids go, repeated ones repeat."""
    have = set(chunks.columns)
    offset = lambda c: (F.col(c) if c in have else F.lit(0)).cast("long").alias(c)
    tokens = F.coalesce(F.col("token_count"), token_count(F.col("text"))) if "token_count" in have else token_count(F.col("text"))
    rows = chunks.select("chunk_id", "document_id", "title", "section", "text", offset("start_char"), offset("end_char"), tokens.alias("token_count"))
    return requests.join(rows, "chunk_id").select("req_id", "pos", *rows.columns)


def chunks_contain(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, found of every requested id."""
    known = chunks.select("chunk_id", F.lit(True).alias("found")).distinct()
    return ids.select("chunk_id").join(known, "chunk_id", "left").select("chunk_id", F.coalesce("found", F.lit(False)).alias("found"))


def count_chunks(chunks: DataFrame) -> DataFrame:
    """count: how many different chunk ids the table has."""
    return chunks.agg(F.countDistinct("chunk_id").alias("count"))


def search_summaries(queries: DataFrame, retrieved: DataFrame, top_k: int = 5) -> DataFrame:
    """query_id, n_results, results (chunk_id, score, title, snippet of 120) of queries with a text."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be from 1 to 50")
    asked = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("query_id")
    best = retrieved.where(F.col("rank") <= top_k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "title", snippet(F.col("snippet"), 120).alias("snippet")))).alias("results"))
    return asked.join(best, "query_id", "left").select("query_id", F.coalesce(F.size("results"), F.lit(0)).alias("n_results"), "results")


def open_top_n(retrieved: DataFrame, chunks: DataFrame, n: int = 3) -> DataFrame:
    """Full chunks of each query's first n results; ids that are not found go."""
    asked = retrieved.where(F.col("rank") <= n).select(F.col("query_id").alias("req_id"), F.col("rank").alias("pos"), "chunk_id")
    return get_many_chunks(asked, chunks)


def build_context(ranked: DataFrame, max_tokens: int = 2048, max_chunks_per_doc: int = 3) -> DataFrame:
    """query_id, context_text, chunk_ids, n_tokens from ranked chunks (query_id, rank, chunk_id, document_id, title, text).

    By rank: repeated chunks go, a document gives at most `max_chunks_per_doc`, and the first chunk over the budget ends
    the context; the very first is always taken. As the running cost only grows, one running sum decides it.
    """
    have = set(ranked.columns)
    own = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(token_count(F.col("text"))) if "token_count" in have else token_count(F.col("text"))
    cost = own + len(SEPARATOR) // 4 + 7  # 7: a quarter of the header's template
    by = Window.partitionBy("query_id")
    rows = ranked.withColumn("_again", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).where("_again = 1")
    rows = rows.withColumn("_of_doc", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank"))).where(F.col("_of_doc") <= max_chunks_per_doc)
    rows = rows.withColumn("_cost", cost).withColumn("_sum", F.sum("_cost").over(by.orderBy("rank"))).withColumn("_first", F.row_number().over(by.orderBy("rank")) == 1)
    rows = rows.where((F.col("_sum") <= max_tokens) | F.col("_first"))
    part = F.concat(F.lit("["), "title", F.lit("] (chunk "), "chunk_id", F.lit(")\n"), "text")
    items = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", part.alias("part"))))
    packed = rows.groupBy("query_id").agg(items.alias("i"), F.sum("_cost").alias("n_tokens"))
    return packed.select("query_id", F.array_join(F.transform("i", lambda x: x["part"]), SEPARATOR).alias("context_text"), F.transform("i", lambda x: x["chunk_id"]).alias("chunk_ids"), "n_tokens")
