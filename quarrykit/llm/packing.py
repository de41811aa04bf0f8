"""Best-fit packing (3): documents as token pieces, packed into sequences of bounded length by exact complements.

1. `tokenized_pieces`: each document's ids, then the separator id; only documents longer than a sequence are cut, with
   the shorter piece first.
2. `plan`: works on the histogram of lengths, which has at most `size` rows whatever the input. `SumIndex` knows for
   every sum the pair of lengths that is available most often, and keeps up with the counts. From the longest length
   down, the gap that a length leaves is looked up among single lengths, pairs and triples (a length and the pair for
   the rest); a combination that fills it exactly is used as often as all its counts allow. A combination of short
   pieces only is passed over (`SPARE`), as later gaps need them. Without one, the longest length that fits goes in and
   the search goes on with what is left of the gap (best fit).
3. `packed_pieces`: pieces are ranked within their length (salted, so that a length which a third of all pieces have is
   spread over many tasks) and rank ranges of the plan give sequence and offset.

Defined cases: null text is empty, so its piece is the separator alone; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns than those named are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import sliced
from .shared import bounded_batches, materialize
from .units import id_bytes

SEQUENCE, SEPARATOR = 1024, 2
SPARE = 0.8
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_encoder(path: str):
    """String -> its ids as bytes (little-endian unsigned 32-bit) by a tokenizers JSON file, without special tokens.

    Where the file is a plain byte-level BPE (no normalizer, no prefix space, merges in the order of their ids), ordinary
    strings go through tiktoken with the same vocabulary, which gives the same ids in half the time; strings that hold an
    added token, and all other files, go through tokenizers itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    from .bpe import PIECE, BytePairs

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    whole = lambda text: id_bytes(tokenizer.encode(text, add_special_tokens=False).ids)
    pairs = BytePairs(path)
    if not pairs.plain:
        return whole
    added = tuple(pairs.added)
    ranks = {s: i for i, s in pairs.strings.items() if i not in set(pairs.added.values())}
    ordinary = tiktoken.Encoding("byte pairs", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: whole(text) if any(s in text for s in added) else id_bytes(ordinary(text))


def tokenized_pieces(docs: DataFrame, path: str, size: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) for every piece of `docs` (doc_id, text)."""

    def run(batches):
        encode, end = id_encoder(path), np.array([separator], "<u4").tobytes()
        for whole in batches:
            for batch in sliced(whole, 1):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    n, at, k = len(ids) // 4, 0, 0
                    while at < n:
                        to = at + ((n - at - 1) % size + 1)
                        rows.append((doc, k, at, to - at, ids[4 * at : 4 * to]))
                        at, k = to, k + 1
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class SumIndex:
    """Available counts by length, and for every sum the pair of lengths of which most are available."""

    def __init__(self, counts: dict[int, int], size: int):
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.often, self.first = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for total in range(2, size + 1):
            self._refresh(total)

    def _refresh(self, total: int) -> None:
        n = self.left[1:total]
        often = np.minimum(n, n[::-1])
        if total % 2 == 0:
            often[total // 2 - 1] = n[total // 2 - 1] // 2
        at = int(often.argmax())
        self.often[total], self.first[total] = often[at], at + 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths of this sum. An entry whose counts have fallen below half is looked up anew."""
        if total < 2 or not self.often[total]:
            return None
        a = int(self.first[total])
        b = total - a
        now = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
        if not now or 2 * now < self.often[total]:
            self._refresh(total)
            a = int(self.first[total])
            b = total - a
        return (max(a, b), min(a, b)) if self.often[total] else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """An available length and the pair for the rest of this sum."""
        if total < 3:
            return None
        often = np.minimum(self.left[1 : total - 1], self.often[total - 1 : 1 : -1])  # counts only fall: an upper bound
        while (at := int(often.argmax())) >= 0 and often[at]:
            self.left[at + 1] -= 1
            self._refresh(total - at - 1)
            rest = self.pair(total - at - 1)
            self.left[at + 1] += 1
            self._refresh(total - at - 1)
            if rest:
                return tuple(sorted((at + 1, *rest), reverse=True))
            often[at] = 0
        return None

    def longest(self, gap: int) -> int:
        """The longest available length that fits, or 0."""
        fits = np.flatnonzero(self.left[: gap + 1])
        return int(fits[-1]) if len(fits) else 0

    def fill(self, gap: int, spare: float) -> tuple[int, ...]:
        """Lengths that fill the gap exactly, the longest of them at least `spare` times the longest that fits; else this one."""
        best = self.longest(gap)
        if best == gap:
            return (gap,) if gap else ()
        for made in (self.pair(gap), self.triple(gap)):
            if made and made[0] >= spare * best:
                return made
        return (best,) if best else ()


def plan(counts: dict[int, int], size: int = SEQUENCE, spare: float = SPARE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences); uses every piece exactly once."""
    stock, out = SumIndex(counts, size), []
    left = stock.left
    for top in range(size, 0, -1):
        while left[top]:
            left[top] -= 1
            held, gap = [top], size - top
            while more := stock.fill(gap, spare):
                for x in more:
                    left[x] -= 1
                held += more
                gap -= sum(more)
            need = {x: held.count(x) for x in set(held)}
            times = 1 + int(min(left[x] // n for x, n in need.items()))
            for x, n in need.items():
                left[x] -= n * (times - 1)
            out.append((tuple(held), times))
    return out


def packed_pieces(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """`pieces` (doc_id, piece, length and any others, whatever their names) with sequence_id and offset in place of columns of these names."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for lengths, times in plan(counts, size):
        offset = 0
        for x in lengths:
            slots.append((x, used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    cols = list(zip(*slots, strict=True)) or [[]] * 5
    ranges = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in cols], ["length", "lo", "hi", "first", "offset"]))
    salts = max(64, sum(counts.values()) // 50_000)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("salt")
    salted = pieces.drop("sequence_id", "offset").select(F.struct("*").alias("row"), "length", salt)
    group = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = group.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row.doc_id", "row.piece")) - 1
    ranked = salted.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside"))
    placed = ranked.join(F.broadcast(ranges), "length").where("rank >= lo and rank < hi")  # as large as the plan, whatever the input
    return placed.select("row.*", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, separator: int = SEPARATOR, digest: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids (or with `digest` only ids_crc32), sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    pieces = tokenized_pieces(docs, path or tokenizer_file(), size, separator)
    if digest:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed_pieces(materialize(pieces, "pieces"), size)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, digest=True).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
