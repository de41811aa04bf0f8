"""Articles (page_id, title, text) to chunks with stable ids. Row-local: no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.text import make_chunk_id, strip_space

COLUMNS = ["chunk_id", "document_id", "title", "section", "text", "start_char", "end_char", "text_length", "chunker_name", "chunker_settings"]


def _finish(rows: DataFrame, name: str, settings: str) -> DataFrame:
    rows = rows.withColumns({"section": F.lit(""), "chunker_name": F.lit(name), "chunker_settings": F.lit(settings), "text_length": F.length("text").cast("long")})
    ids = make_chunk_id(F.col("document_id"), F.col("start_char"), F.col("end_char"), F.col("chunker_name"), F.col("chunker_settings"))
    return rows.withColumn("chunk_id", ids).select(*COLUMNS)


def chunk_fixed(articles: DataFrame, chunk_size: int = 1000, overlap: int = 200, min_chunk_size: int = 100) -> DataFrame:
    """Windows of `chunk_size` characters; one shorter than the minimum is kept only if it is the first."""
    if overlap >= chunk_size:
        raise ValueError("overlap must be smaller than chunk_size")
    step = chunk_size - overlap
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    rows = articles.select(F.col("page_id").alias("document_id"), "title", F.col("text").alias("whole"), F.explode(starts).alias("start"))
    end = F.least(F.col("start") + chunk_size, F.length("whole"))
    rows = rows.withColumn("end", end).where(f"start = 0 or end - start >= {min_chunk_size}")
    rows = rows.select("document_id", "title", F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"))
    return _finish(rows, "fixed_size", f"size={chunk_size},overlap={overlap},min={min_chunk_size}")


_GROUP = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def group_paragraphs(raw: pa.ListArray, clean: pa.ListArray, target: int) -> pa.ListArray:
    """(lengths of paragraphs, lengths without outer white space) -> chunks by first and last paragraph and offsets.

    A paragraph joins the open chunk unless that would pass `target`, and a sum that starts anew at each chunk is a jump
    in the running sum of all lengths. The next chunk of every text of the batch is found at once.
    """
    bounds = raw.offsets.to_numpy().astype(np.int64)
    own = bounds - bounds[0]
    lengths, filled = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (raw, clean))
    sizes = lengths + 2
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(own) - 1), np.diff(own))
    begin -= np.append(begin, 0)[own[:-1]][text]
    kept = np.flatnonzero(filled)
    sums = np.append(0, np.cumsum(filled[kept]))
    at, until = np.searchsorted(kept, own[:-1]), np.searchsorted(kept, own[1:])
    texts, owners, firsts, lasts = np.arange(len(at)), [], [], []
    while len(texts := texts[at[texts] < until[texts]]):
        end = np.searchsorted(sums, sums[at[texts]] + target, "right") - 1
        end = np.minimum(np.maximum(end, at[texts] + 1), until[texts])
        owners.append(texts)
        firsts.append(kept[at[texts]])
        lasts.append(kept[end - 1])
        at[texts] = end
    owner, first, last = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (owners, firsts, lasts))
    order = np.lexsort((first, owner))
    owner, first, last = owner[order], first[order], last[order]
    cols = [pa.array((x - own[owner]).astype(np.int32)) for x in (first, last)]
    groups = pa.StructArray.from_arrays([*cols, pa.array(begin[first]), pa.array(begin[last] + lengths[last])], fields=list(_GROUP))
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(own) - 1)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), groups)


def _paragraph_groups(target: int):
    """`group_paragraphs` on Arrow batches of lengths; texts stay in the JVM."""

    @F.arrow_udf("array<struct<first:int,last:int,start:bigint,end:bigint>>")
    def groups(raw: pa.Array, clean: pa.Array) -> pa.Array:
        return group_paragraphs(raw, clean, target)

    return groups


def chunk_paragraphs(articles: DataFrame, target_size: int = 1000, max_size: int = 1500, min_chunk_size: int = 100) -> DataFrame:
    """Whole paragraphs up to about `target_size` characters; merged texts under the minimum go.

    `max_size` only enters the settings (and so the ids). The work is linear in a text's paragraphs.
    """
    rows = articles.select(F.col("page_id").alias("document_id"), "title", F.split(F.coalesce("text", F.lit("")), "\n\n").alias("parts"))
    rows = rows.withColumn("clean", F.transform("parts", strip_space))
    lengths = [F.transform(c, lambda x: F.length(x)) for c in ("parts", "clean")]
    made = rows.select("document_id", "title", "clean", F.explode(_paragraph_groups(target_size)(*lengths)).alias("g"))
    own = F.slice("clean", F.col("g.first") + 1, F.col("g.last") - F.col("g.first") + 1)
    made = made.select(
        "document_id", "title", F.array_join(F.filter(own, lambda x: x != ""), "\n\n").alias("text"), F.col("g.start").alias("start_char"), F.col("g.end").alias("end_char"),
    )
    return _finish(made.where(F.length("text") >= min_chunk_size), "paragraph_aware", f"target={target_size},max={max_size},min={min_chunk_size}")


CHUNKERS = {"fixed_size": chunk_fixed, "paragraph_aware": chunk_paragraphs}


def chunk_articles(articles: DataFrame, name: str, **settings) -> DataFrame:
    if name not in CHUNKERS:
        raise ValueError(f"no chunker named {name!r}; there are {sorted(CHUNKERS)}")
    return CHUNKERS[name](articles, **settings)


def chunk_summary(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """num_articles, num_chunks, avg_chunk_len."""
    n = articles.agg(F.count("*").alias("num_articles"))
    c = chunks.agg(F.count("*").alias("num_chunks"), F.coalesce(F.sum("text_length"), F.lit(0)).alias("total"))
    return n.join(F.broadcast(c)).select("num_articles", "num_chunks", F.bround(F.col("total") / F.greatest("num_chunks", F.lit(1)), 1).alias("avg_chunk_len"))


def compare_chunkers(chunks: DataFrame) -> DataFrame:
    """Per chunker: number of chunks, least, greatest and mean length."""
    return chunks.groupBy("chunker_name").agg(F.count("*").alias("n_chunks"), F.min("text_length").alias("min_len"), F.max("text_length").alias("max_len"), F.avg("text_length").alias("mean_len"))


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    """Per document the number of chunks of each chunker, side by side."""
    return chunks.groupBy("document_id").pivot("chunker_name", sorted(CHUNKERS)).count().fillna(0)


def diff_chunk_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """chunk_id, side (`left`, `right`, `changed`) of all ids that are not the same in both tables."""
    x, y = (t.select("chunk_id", F.xxhash64("document_id", "text").alias(n)) for t, n in ((a, "l"), (b, "r")))
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").when(F.col("l") != F.col("r"), "changed")
    return x.join(y, "chunk_id", "full_outer").select("chunk_id", side.alias("side")).where("side is not null")
