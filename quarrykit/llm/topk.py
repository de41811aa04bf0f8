"""Exact top-k search (12): integer inner products, found by a three-phase uniform threshold over parts of the vectors.

A score is the sum of `PARTS` partial scores, one for each range of components. Vectors are packed in blocks, and every
block of candidates meets every block of queries as one row.

1. Each block gathers, for each query and part, the list of its `DEPTH` best partial scores. What is on a list is summed
   over all parts; the k-th best sum of all blocks cannot be over the query's true k-th score, so it is a safe cutoff.
2. The cutoff goes with the queries to all blocks. If a score reaches cutoff c, then in some of m parts the partial
   score reaches o + (c - O) / m, where o is the part's usual score in the block (any number would do) and O their sum.
   So each part collects the entries that reach this uniform threshold, and every answer is among them.
3. What was collected is resolved: the parts that did not collect it are added, sums under the cutoff go, and the k best
   of each block are ranked over all blocks.

Components become floor(64 * x). Products are exact: by 32-bit floats while every sum stays under 2^24, by 64-bit floats
under 2^53, else by 64-bit integers, which sums must fit. Integers are packed in as few bytes as they need.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id;
shorter vectors end in zeros; of rows with one vec_id the least vector stands for all, and it is never its own
candidate; equal scores go by vec_id; with fewer candidates than k all are returned; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import packed
from .shared import materialize

PARTS, DEPTH = 2, 64
BLOCK = 4096  # candidates, and at most a quarter as many queries, in a block
_PAIRS = 1 << 20  # scores that are held at once
_NAMES = ["block", "dims", "kind", "ids", "cutoff", "vectors"]
_PACKED = "block long, dims int, kind string, ids binary, cutoff binary, vectors binary"
_NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of all rows that take part, one of each vec_id."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where("vec_id is not null and embedding is not null").where(fit)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def pack(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of up to `most` rows (vec_id, embedding, cutoff) with their components as integers."""

    def run(batches):
        place = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                place += 1
                sizes = np.diff(part.column(1).offsets.to_numpy())
                dims = int(sizes.max(initial=0))
                x = np.zeros((len(sizes), dims), np.int64)
                x[np.arange(dims) < sizes[:, None]] = np.floor(part.column(1).flatten().to_numpy().astype(float) * 64)
                kind = next(k for k in ("i1", "i2", "i4", "i8") if len(x) == 0 or dims == 0 or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
                values = [place, dims, kind, packed(part.column(0).to_numpy(), "<i8"), packed(part.column(2).to_numpy(), "<i8"), packed(x, f"<{kind}")]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * 3), strict=True)], _NAMES)

    return rows.select("vec_id", "embedding", F.coalesce("cutoff", F.lit(_NONE)).alias("cutoff")).mapInArrow(run, _PACKED)


def _unpacked(row: pa.RecordBatch, side: str):
    """Ids, cutoffs and vectors of a block."""
    get = lambda c: row.column(f"{side}{c}")[0].as_py()
    ids = np.frombuffer(get("ids"), "<i8")
    return ids, np.frombuffer(get("cutoff"), "<i8"), np.frombuffer(get("vectors"), f"<{get('kind')}").reshape(len(ids), get("dims"))


def partial_scores(q: np.ndarray, x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Scores of all queries with all candidates by each part of the components, exact."""
    dims = min(q.shape[1], x.shape[1])
    most = dims * max(1, int(np.abs(q.astype(float)).max(initial=0))) * max(1, int(np.abs(x.astype(float)).max(initial=0)))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    q, x = q[:, :dims].astype(kind), x[:, :dims].astype(kind)
    cuts = np.linspace(0, dims, min(parts, max(dims, 1)) + 1).astype(int)
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def listed(scores: list[np.ndarray], own: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) on any list of the `depth` best partial scores; `own` marks a query's own row."""
    chosen = np.zeros(own.shape, bool)
    for s in scores:
        if s.shape[1] <= depth:
            chosen[:] = True
            break
        np.put_along_axis(chosen, np.argpartition(s, s.shape[1] - depth, axis=1)[:, -depth:], True, axis=1)
    return np.nonzero(chosen & ~own)


def sufficient(scores: list[np.ndarray], own: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) whose partial score reaches the uniform threshold in any part."""
    usual = [np.rint(s.mean(axis=1, dtype=float)).astype(np.int64) for s in scores]
    m, chosen = len(scores), np.zeros(own.shape, bool)
    bounded = cutoff > _NONE
    share = -(-(np.where(bounded, cutoff, 0) - sum(usual)) // m)  # least integer that is not under (c - O) / m
    for s, o in zip(scores, usual, strict=True):
        chosen |= s >= (o + share)[:, None]
    chosen[~bounded] = True
    return np.nonzero(chosen & ~own)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query; ties by id."""
    order = np.lexsort((ids, -score, query))
    new = np.concatenate(([True], query[order[1:]] != query[order[:-1]])) if len(order) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def _meetings(candidates: DataFrame, queries: DataFrame, groups: int) -> DataFrame:
    """Every block of candidates with every block of queries; the smaller side, queries, is copied to all groups of blocks.

    Both sides are shuffled: a broadcast would be chosen by the size of the queries before they are copied, and would send
    all copies through the driver.
    """
    left = candidates.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
    right = queries.select(*(F.col(c).alias(f"q_{c}") for c in _NAMES)).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return left.join(right.hint("merge"), "g").select(*_NAMES, *(f"q_{c}" for c in _NAMES))


def _search(met: DataFrame, choose, k: int, sums: bool) -> DataFrame:
    """query_id, vec_id, score of the k best that `choose` takes in each meeting; with `sums` no score under the cutoff."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                (ids, _, x), (asked, cutoff, q) = _unpacked(row, ""), _unpacked(row, "q_")
                step = max(1, _PAIRS // max(1, len(ids)))
                for at in range(0, len(asked), step):
                    queries = slice(at, at + step)
                    scores = partial_scores(q[queries], x, PARTS)
                    a, b = choose(scores, asked[queries, None] == ids[None], cutoff[queries])
                    score = sum(s[a, b].astype(np.int64) for s in scores)
                    if sums:
                        keep = score >= cutoff[queries][a]
                        a, b, score = a[keep], b[keep], score[keep]
                    best = _best(a, ids[b], score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[queries][a[best]]), pa.array(ids[b[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; Spark cuts each task's rows to k a query before it shuffles them."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, every: int = 20, k: int = 20, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k best of all other rows."""
    spark = rows.sparkSession
    rows = materialize(whole_vectors(rows), "vectors")
    none = F.lit(_NONE).alias("cutoff")
    asked = rows.where(F.col("vec_id") % every == 0)
    candidates = materialize(pack(rows.withColumn("cutoff", none), block), "candidates")
    groups = max(1, min(candidates.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def gather(scores, own, cutoff):
        return listed(scores, own, max(depth, k + 1))

    first = _search(_meetings(candidates, pack(asked.withColumn("cutoff", none), block // 4), groups), gather, k, False)
    cutoff = ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    bounded = materialize(pack(asked.join(cutoff, "vec_id", "left"), block // 4), "queries")
    found = _search(_meetings(candidates, bounded, groups), sufficient, k, True)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op12_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, min(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
n AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, 1 + least(len(a.e), len(b.e))), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, coalesce(score, 0) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, vec_id) QUALIFY rank <= 20
"""
