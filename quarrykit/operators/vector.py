"""Embedding jobs and exact nearest-neighbour search for a whole table of queries.

Index rows are assigned to the nearest of some centres and packed in blocks of one cell, ordered by their distance to its
centre. Queries go to the blocks, which stay where they are. A query's nearest cells give a limit for its k-th distance;
then only blocks that can have a row within the limit are read for it. So results are exact, and what is shuffled are the
best k of each block.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.sources.tables import scratch, small_batches, upsert

from .keyword import best_columns, top_k
from .models import Model, loaded, run_by_length

BLOCK = 1024  # index rows in a block, at most
ONE_CELL = 8192  # rows up to which there is one cell
SAMPLE = 4096  # rows on which centres are fitted, at most
ROUND = 32 << 20  # bytes of the queries of a round, with their distances to the centres
_TEXTS = 2048  # texts that are ordered by length and embedded at once
_ROWS = 512  # rows that meet all centres at once
_PAIRS = 1 << 19  # distances of queries and rows of a block that are held at once
Embed = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embed:
    """A deterministic embedder without a model: signed hashes of words."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        return out

    return embed


def prefix_for(model: str, kind: str, prefix: str | None = None) -> str:
    """E5-like models want `passage: ` or `query: `; an explicit prefix wins."""
    return prefix if prefix is not None else f"{kind}: " if "e5" in model.lower() else ""


def embed_texts(rows: DataFrame, embed: Embed | Model, model: str = "hashing", kind: str = "passage", batch: int = 512, prefix: str | None = None, cells: int | None = None) -> DataFrame:
    """`rows` with vector: the unit vector of `text`.

    A `Model` is loaded once per worker. Batches hold texts of like length, up to `batch` of them and, padded, up to
    `cells` characters; rows keep their order.
    """
    head, batch_size = prefix_for(model, kind, prefix), batch

    def run(batches):
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for batch in (whole.slice(i, _TEXTS) for i in range(0, whole.num_rows, _TEXTS)):
                texts = [head + (t or "") for t in batch.column(at).to_pylist()]
                made = np.asarray(run_by_length(lambda part: np.asarray(loaded(embed)(part), np.float32), [texts], batch_size, cells), np.float32)
                unit = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
                ends = pa.array(np.arange(len(unit) + 1) * unit.shape[1], pa.int32())
                yield batch.append_column("vector", pa.ListArray.from_arrays(ends, pa.array(unit.ravel())))

    rows = rows.drop("vector")
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["vector array<float>"]))


def embed_queries(queries: DataFrame, embed: Embed | Model, model: str = "hashing", batch: int = 256, prefix: str | None = None) -> DataFrame:
    return embed_texts(queries, embed, model, "query", batch, prefix)


def stored(rows: DataFrame) -> DataFrame:
    """`rows` written to a new shared folder and read from there: what an embedder makes is made once."""
    path = scratch(rows.sparkSession, "vectors")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_chunk_index(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """`chunks` with vectors as a table; mode overwrite, append or upsert (by chunk_id: a repeated call changes nothing)."""
    rows = chunks.select("chunk_id", "document_id", "title", "section", "text", "vector")
    if mode == "upsert":
        upsert(rows, path, ["chunk_id"])
    else:
        rows.write.mode(mode).parquet(path)


def index_summary(index: DataFrame) -> DataFrame:
    """num_chunks, embedding_dim (0 if empty), rows_written."""
    return index.agg(F.count("*").alias("num_chunks"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("embedding_dim"), F.count("*").alias("rows_written"))


def build_vector_index(chunks: DataFrame, embed: Embed | Model, path: str, model: str = "hashing", mode: str = "overwrite") -> DataFrame:
    write_chunk_index(embed_texts(chunks, embed, model), path, mode)
    return index_summary(chunks.sparkSession.read.parquet(path))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


class CellIndex(NamedTuple):
    """blocks (cell, n, near, far: least and greatest distance to the cell's centre, ids, vectors) and the cells' centres.

    Without centres there is one cell around the origin.
    """

    blocks: DataFrame
    centers: np.ndarray


def _matrix(vectors: pa.Array, kind=np.float64) -> np.ndarray:
    return vectors.flatten().cast(pa.from_numpy_dtype(kind)).to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to all rows of `b`."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit_centers(sample: np.ndarray, cells: int, steps: int = 8) -> np.ndarray:
    """Centres of cells by Lloyd's steps, from spread rows of the sample on; cells that become empty stay where they were."""
    centers = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(steps if len(centers) < len(sample) else 0):
        own = distances(sample, centers).argmin(1)
        count = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        centers[count > 0] = sums[count > 0] / count[count > 0, None]
    return centers


def build_cell_index(index: DataFrame, path: str | None = None, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> CellIndex:
    """Every row of `index` (chunk_id, vector) in blocks of one cell, written to `path` or to a new shared folder.

    Centres are fitted on the rows with the smallest hashes of their ids, at most `sample`; any centres give right
    results. Rows without a vector are left out. Large cells are split by size, so no cell's rows meet in one task.
    `index` is read up to three times, so it should be a table (see `stored`).
    """
    spark, kind = index.sparkSession, index.schema["chunk_id"].dataType.simpleString()
    small_batches(spark)
    rows = index.where("vector is not null").select("chunk_id", "vector")
    total = 0 if cells else rows.count()
    cells = cells or (min(1024, round(total**0.5)) if total > ONE_CELL else 1)
    centers = np.zeros((0, 0))
    if cells > 1:
        chosen = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
        centers = fit_centers(_matrix(chosen), cells) if len(chosen) else centers
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                x = _matrix(batch.column(1))
                far = distances(x, shared.value if len(shared.value) else np.zeros((1, x.shape[1])))
                cell = far.argmin(1)
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("far", pa.array(np.sqrt(far[np.arange(len(far)), cell])))

    def pack(batches):
        for batch in batches:
            cell, far = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            starts = np.union1d(np.flatnonzero(np.diff(cell)) + 1, np.arange(0, len(cell), block)).astype(int)
            for a, b in zip(starts, np.append(starts[1:], len(cell)), strict=True):
                part = batch.slice(a, b - a)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False)  # 32 or 64 bits, as given
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), part.column(0))
                cols = [pa.array([cell[a]], pa.int32()), pa.array([b - a], pa.int32()), pa.array([far[a]]), pa.array([far[b - 1]]), ids, pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["cell", "n", "near", "far", "ids", "vectors"])

    placed = rows.mapInArrow(assign, f"chunk_id {kind}, vector {rows.schema['vector'].dataType.simpleString()}, cell int, far double")
    packed = placed.hint("rebalance", "cell").sortWithinPartitions("cell", "far").mapInArrow(pack, f"cell int, n int, near double, far double, ids array<{kind}>, vectors binary")
    path = path or scratch(spark, "cells")
    packed.write.mode("overwrite").parquet(f"{path}/blocks")
    return CellIndex(spark.read.schema(packed.schema).parquet(f"{path}/blocks"), centers)


def write_cell_index(cells: CellIndex, path: str) -> None:
    """A copy of an index, for many searches."""
    spark = cells.blocks.sparkSession
    cells.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, c) for i, c in enumerate(cells.centers.tolist())], "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")


def read_cell_index(spark, path: str) -> CellIndex:
    rows = spark.read.parquet(f"{path}/centers").orderBy("cell").select("center").toArrow()["center"].combine_chunks()  # one row a cell
    return CellIndex(spark.read.parquet(f"{path}/blocks"), _matrix(rows) if len(rows) else np.zeros((0, 0)))


def _score(near: np.ndarray) -> np.ndarray:
    return np.round(1 / (1 + near), 9)


def _meet(blocks: DataFrame, ids: pa.Array, asked: np.ndarray, choose, k: int, squared: bool, query_kind: str) -> DataFrame:
    """query_id, chunk_id, distance: in each block the k nearest of those queries that `choose` (cell, near, far) marks."""
    chunk_kind = blocks.schema["ids"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast((ids, asked, choose))

    def run(batches):
        ids, asked, choose = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                cell, _, low, high = (batch.column(c)[i].as_py() for c in range(4))
                queries = np.flatnonzero(choose(cell, low, high))
                if len(queries):
                    chunk_ids = batch.column(4).slice(i, 1).flatten()
                    data = batch.column(5)[i].as_py()
                    kind = np.float32 if len(data) == 4 * len(chunk_ids) * asked.shape[1] else np.float64
                    x = np.frombuffer(data, kind).reshape(len(chunk_ids), -1).astype(float)
                    step = max(1, _PAIRS // len(x))
                    for part in (queries[at : at + step] for at in range(0, len(queries), step)):
                        near = distances(asked[part], x) if squared else np.sqrt(distances(asked[part], x))
                        r, c, _ = best_columns(_score(near), chunk_ids, k)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(part[r])), chunk_ids.take(pa.array(c)), pa.array(near[r, c])], ["query_id", "chunk_id", "distance"])

    made = blocks.select("cell", "n", "near", "far", "ids", "vectors").mapInArrow(run, f"query_id {query_kind}, chunk_id {chunk_kind}, distance double")
    return made.withColumn("score", F.round(1 / (1 + F.col("distance")), 9))


class Probe(NamedTuple):
    """Marks queries whose nearest cells, as many as hold k rows, have the block's cell."""

    wanted: np.ndarray

    def __call__(self, cell: int, near: float, far: float) -> np.ndarray:
        return self.wanted[:, cell]


class Bound(NamedTuple):
    """Marks queries that may have a row of the block within their limit: by the triangle inequality no row is nearer."""

    to_center: np.ndarray
    limit: np.ndarray

    def __call__(self, cell: int, near: float, far: float) -> np.ndarray:
        d = self.to_center[:, cell]
        return np.maximum(d - far, near - d) <= self.limit


def _nearest(cells: CellIndex, rows: pa.Table, count: np.ndarray | None, k: int, squared: bool, query_kind: str) -> DataFrame:
    """Distances that can be among the k least of each query: a limit from the nearest cells, then all blocks within it."""
    ids, asked = rows["query_id"].combine_chunks(), _matrix(rows["vector"].combine_chunks())
    if count is None:
        return _meet(cells.blocks, ids, asked, Bound(np.zeros((len(ids), 1)), np.full(len(ids), np.inf)), k, squared, query_kind)
    to_center = np.sqrt(distances(asked, cells.centers))
    order = to_center.argsort(1)
    before = np.cumsum(count[order], 1) - count[order]
    wanted = np.zeros(to_center.shape, bool)
    np.put_along_axis(wanted, order, before < k, 1)
    first = top_k(_meet(cells.blocks, ids, asked, Probe(wanted), k, squared, query_kind), k).where(F.col("rank") == k)
    kth = first.select("query_id", "score").toArrow()  # one row a query
    at = pa.compute.index_in(ids, value_set=kth["query_id"].combine_chunks()).fill_null(-1).to_numpy()
    limit = np.full(len(ids), np.inf)
    score = kth["score"].to_numpy()[at[at >= 0]]
    far = 1 / np.maximum(score - 2e-9, 1e-12) - 1  # what rounds to the same score is within
    limit[at >= 0] = (np.sqrt(far) if squared else far) * (1 + 1e-6) + 1e-6
    return _meet(cells.blocks, ids, asked, Bound(to_center, limit), k, squared, query_kind)


def vector_search(queries: DataFrame, index: DataFrame | CellIndex, k: int = 20, squared: bool = True, block: int = BLOCK) -> DataFrame:
    """query_id, rank, chunk_id, score, source of the k nearest rows by L2; score = 1 / (1 + distance).

    `queries`: query_id, vector; `index`: chunk_id, vector, or its cells. Rows without a vector are left out. Queries go
    to all blocks in rounds of about `ROUND` bytes with their distances to the centres, by hash of query_id.
    """
    spark, query_kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    small_batches(spark)
    cells = index if isinstance(index, CellIndex) else build_cell_index(index, block=block)
    count = np.zeros(len(cells.centers), np.int64) if len(cells.centers) > 1 else None
    for row in cells.blocks.groupBy("cell").agg(F.sum("n").alias("n")).collect() if count is not None else []:  # one row a cell
        count[row["cell"]] = row["n"]
    asked = queries.where("vector is not null").select("query_id", "vector")
    size = asked.agg(F.sum(F.size("vector") + len(cells.centers))).first()[0] or 0
    rounds, made = max(1, -(-size * 8 // ROUND)), None
    for i in range(rounds):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i) if rounds > 1 else asked
        rows = own.toArrow()  # of one round
        if rows.num_rows:
            part = _nearest(cells, rows, count, k, squared, query_kind)
            made = part if made is None else made.union(part)
    chunk_kind = cells.blocks.schema["ids"].dataType.elementType.simpleString()
    if made is None:
        made = spark.createDataFrame([], f"query_id {query_kind}, chunk_id {chunk_kind}, distance double, score double")
    return top_k(made, k).select("query_id", "rank", "chunk_id", "score", F.lit("vector").alias("source"))
