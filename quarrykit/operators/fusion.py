"""Rank fusion, reranking and comparisons of ranked lists, for a whole table of queries.

Ranked lists have query_id, list_no, rank, chunk_id and any of score, source, title, section, document_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.text import snippet

from .keyword import FEW, terms_of, top_k
from .models import Model, loaded, run_by_length

META = ["title", "section", "document_id"]


def ranked_lists(*lists: DataFrame) -> DataFrame:
    """Lists under one roof, numbered from 1; absent metadata is null."""
    made = None
    for i, x in enumerate(lists, 1):
        part = x.select("query_id", F.lit(i).alias("list_no"), "rank", "chunk_id", *(F.col(c).cast("string").alias(c) if c in x.columns else F.lit(None).cast("string").alias(c) for c in META))
        made = part if made is None else made.unionByName(part)
    return made


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, top_n: int = 50, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Sum of 1 / (k + rank); ties by chunk_id; metadata of the first list that has the chunk."""
    kk = F.col("k") if "k" in keys else F.lit(k)
    meta = [c for c in META if c in lists.columns]
    grouped = lists.groupBy(*keys, "chunk_id").agg(F.sum(1 / (kk + F.col("rank"))).alias("score"), *(F.min_by(c, "list_no").alias(c) for c in meta))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    scored = grouped.withColumn("score", F.round("score", 9))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select(*keys, "rank", "chunk_id", "score", F.lit("hybrid").alias("source"), *meta)


def hybrid_merge(keyword: DataFrame, vector: DataFrame, k: int = 60, keyword_n: int = 20, vector_n: int = 20, top_n: int = 50) -> DataFrame:
    return reciprocal_rank_fusion(ranked_lists(keyword.where(F.col("rank") <= keyword_n), vector.where(F.col("rank") <= vector_n)), k, top_n)


Score = Callable[[pd.Series, pd.Series], pd.Series]


def scorer(score: Score | Model, batch: int = 32, cells: int | None = None):
    """A UDF of (query text, chunk text). A `Model` scores lists of pairs of like length and is loaded once per worker."""
    if not isinstance(score, Model):
        return F.pandas_udf(score, "double")

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for asked, texts in batches:
            yield pd.Series(run_by_length(loaded(score), [asked.fillna("").tolist(), texts.fillna("").tolist()], batch, cells), dtype=float)

    return run


def rerank(queries: DataFrame, candidates: DataFrame, score: Score | Model | None = None, top_n: int = 5) -> DataFrame:
    """Scores (query text, chunk text) pairs and keeps the best. Without a scorer: share of query terms in the chunk.

    `candidates`: query_id, chunk_id, text.
    """
    pairs = candidates.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    if score is None:
        q, t = F.array_distinct(terms_of(F.col("query_text"))), terms_of(F.col("text"))
        value = F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
    else:
        value = scorer(score)("query_text", "text")
    scored = pairs.withColumn("score", F.round(value, 9)).drop("query_text", "rank")
    return top_k(scored, top_n).withColumnRenamed("score", "rerank_score")


def retrieve(queries: DataFrame, merged: DataFrame, chunks: DataFrame, top_k_: int = 5, score: Score | Model | None = None, use_reranker: bool = True, fill_snippets: bool = True, most: int | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score, title, section, snippet. Text is joined late, after fusion.

    `most`: rows of `merged` for one query, at most. If that makes few rows in all, they are broadcast to the chunks.
    """
    texts = chunks.select("chunk_id", "title", "section", "text")
    few = most is not None and queries.count() * most <= FEW
    hint = F.broadcast if few else lambda rows: rows
    if use_reranker:
        best = rerank(queries, texts.join(hint(merged.select("query_id", "chunk_id")), "chunk_id"), score, top_k_)
        return best.select("query_id", "rank", "chunk_id", F.col("rerank_score").alias("score"), "title", "section", snippet(F.col("text")).alias("snippet"))
    best = merged.where(F.col("rank") <= top_k_).select("query_id", "rank", "chunk_id", "score")
    texts = texts.join(hint(best.select("chunk_id").distinct()), "chunk_id", "left_semi")
    text = snippet(F.col("text")) if fill_snippets else F.lit("")
    return best.join(texts, "chunk_id", "left").select("query_id", "rank", "chunk_id", "score", "title", "section", text.alias("snippet"))


def confidence_check(queries: DataFrame, retrieved: DataFrame, threshold: int = 2) -> DataFrame:
    """query_id, n_retrieved, needs_fallback, for queries without any result too."""
    n = retrieved.groupBy("query_id").agg(F.count("*").alias("n_retrieved"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"), (F.coalesce("n_retrieved", F.lit(0)) < threshold).alias("needs_fallback"))


def retrieval_comparison(vector: DataFrame, keyword: DataFrame, hybrid: DataFrame, reranked: DataFrame, final_n: int = 5) -> DataFrame:
    """Per query and chunk of any list its rank and score in each, and whether it is in the final list."""
    named = {"semantic": vector, "bm25": keyword, "hybrid": hybrid, "reranked": reranked}
    made = None
    for name, x in named.items():
        score = "rerank_score" if "rerank_score" in x.columns else "score"
        part = x.select("query_id", "chunk_id", F.lit(name).alias("list"), "rank", F.col(score).alias("score"))
        made = part if made is None else made.unionByName(part)
    return made.groupBy("query_id", "chunk_id").agg(
        *(F.max(F.when(F.col("list") == n, F.col(c))).alias(f"{n}_{c}") for n in named for c in ("rank", "score")),
        (F.coalesce(F.max(F.when(F.col("list") == "reranked", F.col("rank"))), F.lit(final_n + 1)) <= final_n).alias("in_final"),
    )


def sweep_rrf_k(lists: DataFrame, ks: tuple[int, ...] = (1, 10, 30, 60, 120), top_n: int = 5) -> DataFrame:
    each = lists.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    return reciprocal_rank_fusion(each, top_n=top_n, keys=("query_id", "k"))


def sweep_candidate_balance(keyword: DataFrame, vector: DataFrame, settings=((5, 30), (20, 20), (30, 5)), top_n: int = 5) -> DataFrame:
    lists = ranked_lists(keyword, vector)
    cuts = F.array(*(F.struct(F.lit(a).alias("keyword_n"), F.lit(b).alias("vector_n")) for a, b in settings))
    each = lists.withColumn("cut", F.explode(cuts)).select("*", "cut.*").drop("cut")
    each = each.where(F.col("rank") <= F.when(F.col("list_no") == 1, F.col("keyword_n")).otherwise(F.col("vector_n")))
    return reciprocal_rank_fusion(each, top_n=top_n, keys=("query_id", "keyword_n", "vector_n"))


def score_distribution(ranked: DataFrame, top_n: int = 20) -> DataFrame:
    """Per query the least and greatest score and the gap between the first two."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return ranked.where(F.col("rank") <= top_n).groupBy("query_id").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.round(at(1) - at(2), 9).alias("gap"))
