"""Keyword index and BM25 search for a whole table of queries.

Terms are runs of letters and digits, lower-cased; k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a
term repeated in a query counts once; ties go by chunk_id.

The index is sharded by chunks: a shard has up to `SHARD` chunks and, for each of their terms, an inverted list. Lists are
cut into blocks at fixed ranges of `RANGE` chunks, and a posting is its place in the range and its frequency. A block
knows its largest frequency and its shortest chunk, so what it can add to a score has a bound for any average length.

A search leaves the shards where they are. The queries' terms go to all tasks, in rounds of bounded size. For each query
the bounds of its terms' blocks add up to a bound for each range; ranges are scored from the highest bound on, and those
whose bound is under the k-th score so far are skipped. A task carries these scores from shard to shard. Only the best k
of each query and task are shuffled and ranked, and they are exact.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.sources.tables import scratch, small_batches

K1, B = 1.2, 0.75
SHARD, RANGE = 4096, 32  # chunks of a shard (places of 16 bits) and of a range
ROUND = 4 << 20  # characters of the queries of a round
FEW = 100_000  # result rows up to which texts are looked up by a broadcast
_FIRST = 4  # ranges that are scored before any is skipped
_SLACK = 1e-6  # over what rounding may add to a score
_LISTS = ["blocks", "block_range", "block_size", "block_tf", "block_dl", "place", "tf"]


class KeywordIndex(NamedTuple):
    """shards (see `pack_shard`), terms (term, df), size (one row: n, avgdl); `counted` if terms are a table of their own."""

    shards: DataFrame
    terms: DataFrame
    size: DataFrame
    counted: bool = False


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def _small(a: np.ndarray) -> bytes:
    """Whole numbers in 1 or 4 bytes each."""
    return a.astype("<u1" if a.max(initial=0) < 256 else "<u4").tobytes()


def _whole(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u1" if len(data) == n else "<u4")


def pack_shard(ids: pa.Array, terms: pa.ListArray) -> pa.RecordBatch:
    """One row: n, tokens, chunk_ids, dl, terms, df and the terms' lists, laid end to end.

    blocks: number of each term's blocks; block_range, block_size (postings), block_tf (largest), block_dl (least): of
    each block; place (of the chunk in the range), tf: of each posting.
    """
    words, dl = terms.flatten().dictionary_encode(), np.diff(terms.offsets.to_numpy())
    n = max(1, len(dl))
    cell, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    term, chunk = np.divmod(cell, n)
    part = chunk // RANGE
    first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (part[1:] != part[:-1])))) if len(cell) else np.zeros(0, np.int64)
    most, least = (f.reduceat(v, first) if len(first) else v[:0] for f, v in ((np.maximum, tf), (np.minimum, dl[chunk])))
    lists = [
        _small(np.bincount(term[first], minlength=len(words.dictionary))), part[first].astype("<u2").tobytes(), _small(np.diff(np.append(first, len(cell)))), _small(most),
        least.astype("<u4").tobytes(), (chunk % RANGE).astype("<u1").tobytes(), _small(tf),
    ]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    df = pa.array(np.bincount(term, minlength=len(words.dictionary)).astype(np.int32))
    columns = [pa.array([len(dl)], pa.int64()), pa.array([dl.sum()], pa.int64()), one(ids), one(pa.array(dl, pa.int32())), one(words.dictionary), one(df)]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in lists)], ["n", "tokens", "chunk_ids", "dl", "terms", "df", *_LISTS])


def build_keyword_index(chunks: DataFrame, path: str | None = None) -> KeywordIndex:
    """Writes the shards of `chunks` (chunk_id, text) to `path`, or to a new shared folder; texts are read once."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SHARD):
                part = batch.slice(a, SHARD)
                yield pack_shard(part.column(0), part.column(1))

    fields = f"n long, tokens long, chunk_ids array<{kind}>, dl array<int>, terms array<string>, df array<int>, " + ", ".join(f"{c} binary" for c in _LISTS)
    shards = chunks.select("chunk_id", terms_of(F.col("text")).alias("t")).mapInArrow(pack, fields)
    path = path or scratch(chunks.sparkSession, "keyword")
    shards.write.mode("overwrite").parquet(f"{path}/shards")
    return _of_shards(chunks.sparkSession.read.schema(shards.schema).parquet(f"{path}/shards"))


def _of_shards(shards: DataFrame) -> KeywordIndex:
    pairs = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select("x.*")
    terms = pairs.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df"))
    size = shards.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))
    return KeywordIndex(shards, terms, size)


def write_keyword_index(index: KeywordIndex, path: str) -> None:
    """A copy of an index with its terms counted, for many searches."""
    index.shards.write.mode("overwrite").parquet(f"{path}/shards")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")


def read_keyword_index(spark, path: str) -> KeywordIndex:
    index = _of_shards(spark.read.parquet(f"{path}/shards"))
    return index._replace(terms=spark.read.parquet(f"{path}/terms"), counted=True)


def _document_counts(index: KeywordIndex, words: DataFrame) -> DataFrame:
    """query_id, term, df of the words (query_id, term) of a round; without counted terms, from those shards' lists alone."""
    if index.counted:
        return index.terms.join(F.broadcast(words), "term")
    wanted = F.broadcast(words.select(F.col("term").alias("terms")).distinct())
    pairs = index.shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select("x.*").join(wanted, "terms", "left_semi")
    return words.join(pairs.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df")), "term")


class Asked(NamedTuple):
    """The queries of a round: ids, their words, and for query i the words and weights from `at[i]` to `at[i + 1]`."""

    ids: pa.Array
    words: pa.Array
    at: np.ndarray
    word: np.ndarray
    idf: np.ndarray
    avgdl: float


def _rounds(queries: DataFrame, index: KeywordIndex):
    """`Asked` of all queries with a term of the index, in rounds of about `ROUND` characters by hash of query_id."""
    total = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    n, avgdl = index.size.select("n", "avgdl").first()  # one row
    rounds = max(1, -(-total // ROUND))
    for i in range(rounds if n else 0):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i) if rounds > 1 else queries
        words = own.select("query_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct()
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rows = _document_counts(index, words).select("query_id", "term", idf.alias("idf")).toArrow()  # of one round
        ids, words = (rows[c].combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        order = np.argsort(ids.indices.to_numpy(), kind="stable")
        at = np.append(0, np.cumsum(np.bincount(ids.indices.to_numpy(), minlength=len(ids.dictionary))))
        if len(order):
            yield Asked(ids.dictionary, words.dictionary, at, words.indices.to_numpy()[order], rows["idf"].to_numpy()[order], avgdl)


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each `begin` on, `size` of them."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


class Shard:
    """A shard's lists, ready for search."""

    def __init__(self, row: pa.RecordBatch, avgdl: float):
        get = lambda c: row.column(c)[0].as_py()
        self.ids, self.dl, self.terms = row.column("chunk_ids").flatten(), row.column("dl").flatten().to_numpy(), row.column("terms").flatten()
        blocks = _whole(get("blocks"), len(self.terms)).astype(np.int64)
        self.block_at = np.append(0, np.cumsum(blocks))
        n = int(self.block_at[-1])
        self.range = np.frombuffer(get("block_range"), "<u2").astype(np.int64)
        self.size = _whole(get("block_size"), n).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.place, postings = np.frombuffer(get("place"), "<u1"), len(get("place"))
        self.tf = _whole(get("tf"), postings)
        self.norm = K1 * (1 - B + B * self.dl / avgdl)
        most = _whole(get("block_tf"), n).astype(float)
        self.bound = most * (K1 + 1) / (most + K1 * (1 - B + B * np.frombuffer(get("block_dl"), "<u4") / avgdl))

    def search(self, term: np.ndarray, idf: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Chunks and scores that can be among the best k, where `least` is a k-th score so far; blocks that were read."""
        count = self.block_at[term + 1] - self.block_at[term]
        block, weight = _stretches(self.block_at[term], count), np.repeat(idf, count)
        ranges = self.range[block]
        bound = np.bincount(ranges, weight * self.bound[block], minlength=-(-len(self.dl) // RANGE)) + _SLACK
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > _SLACK]
        chunks, scores, read, at = np.zeros(0, np.int64), np.zeros(0), 0, 0
        while at < len(order) and bound[order[at]] >= least:
            chosen = order[at : at + (_FIRST if at == 0 else max(_FIRST, len(order)))]
            at += len(chosen)
            wanted = np.zeros(len(bound), bool)
            wanted[chosen[bound[chosen] >= least]] = True
            use = wanted[ranges]
            b, w = block[use], weight[use]
            posting = _stretches(self.begin[b], self.size[b])
            chunk = np.repeat(self.range[b] * RANGE, self.size[b]) + self.place[posting]
            tf = self.tf[posting].astype(float)
            score = np.bincount(chunk, np.repeat(w, self.size[b]) * (tf * (K1 + 1) / (tf + self.norm[chunk])), minlength=len(self.dl))
            found = np.flatnonzero(score > 0)
            read += len(b)
            chunks, scores = np.append(chunks, found), np.append(scores, score[found])
            if len(scores) >= k:
                least = max(least, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
        keep = scores >= least - _SLACK
        return chunks[keep], np.round(scores[keep], 9), read


def _search(index: KeywordIndex, asked: Asked, k: int, query_kind: str) -> DataFrame:
    chunk_kind = index.shards.schema["chunk_ids"].dataType.elementType.simpleString()
    small_batches(index.shards.sparkSession)
    shared = index.shards.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        asked = shared.value
        best = np.zeros((len(asked.ids), k))
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1), asked.avgdl)
                known = pa.compute.index_in(asked.words, value_set=shard.terms).fill_null(-1).to_numpy()
                queries, chunks, scores = [], [], []
                for q in range(len(asked.ids)):
                    own = slice(asked.at[q], asked.at[q + 1])
                    term = known[asked.word[own]]
                    met = term >= 0
                    if not met.any():
                        continue
                    chunk, score, _ = shard.search(term[met], asked.idf[own][met], best[q, 0], k)
                    queries.append(np.full(len(chunk), q))
                    chunks.append(chunk)
                    scores.append(score)
                    best[q] = np.sort(np.append(best[q], score))[-k:]
                if queries:
                    q, c = (pa.array(np.concatenate(v)) for v in (queries, chunks))
                    yield pa.RecordBatch.from_arrays([asked.ids.take(q), shard.ids.take(c), pa.array(np.concatenate(scores))], ["query_id", "chunk_id", "score"])

    return index.shards.drop("n", "tokens", "df").mapInArrow(run, f"query_id {query_kind}, chunk_id {chunk_kind}, score double")


def bm25_scores(queries: DataFrame, index: KeywordIndex, k: int = 20) -> DataFrame:
    """query_id, chunk_id, score: all that can be among the best k of any query."""
    kind, made = queries.schema["query_id"].dataType.simpleString(), None
    for asked in _rounds(queries, index):
        part = _search(index, asked, k, kind)
        made = part if made is None else made.union(part)
    chunk_kind = index.shards.schema["chunk_ids"].dataType.elementType.simpleString()
    return queries.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id {chunk_kind}, score double") if made is None else made


def best_columns(score: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best in every row of `score`; ties by id."""
    if score.shape[1] > k:
        row, column = np.nonzero(score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, column = np.divmod(np.arange(score.size), max(1, score.shape[1]))
    place = np.empty(len(ids), np.int64)
    place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((place[column], -score[row, column], row))
    row, column = row[order], column[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
    row, column = row[keep], column[keep]
    return row, column, score[row, column]


def top_k(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """Best k rows of each query with their rank; the engine prunes within partitions before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_search(queries: DataFrame, index: KeywordIndex, chunks: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, chunk_id, score, source, title, section, document_id, text.

    Few results are broadcast to the chunks, so that chunks stay where they are; many are joined by a shuffle.
    """
    best = top_k(bm25_scores(queries, index, k), k)
    best = F.broadcast(best) if queries.count() * k <= FEW else best
    texts = chunks.select("chunk_id", "title", "section", "document_id", "text")
    source = F.lit("keyword").alias("source")
    return texts.join(best, "chunk_id").select("query_id", "rank", "chunk_id", "score", source, "title", "section", "document_id", "text")
