"""BPE encoding and decoding (9): a priority queue of merge ranks over a doubly linked list of symbols.

Every neighbouring pair that has a merge goes into a heap by (rank, position). The least entry is popped; if its symbols
have changed meanwhile it is stale and skipped, else both become one symbol and the two new neighbouring pairs are
pushed. Decoding concatenates the vocabulary's byte strings.

Defined cases: null text is empty; an empty text has no ids; strings of added tokens get their own id; very long texts
are encoded whole, piece by piece; repeated rows get equal results; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import sliced
from .packing import tokenizer_file
from .shared import bounded_batches
from .units import LONGEST, PartCache, id_bytes

#: Fixed: how a byte-level BPE of this family cuts text into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte: itself if visible in Latin-1, else the next free one from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Vocabulary and merges of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        vocab = spec["model"]["vocab"]
        self.strings: dict[int, bytes] = {i: bytes(letter[c] for c in s) for s, i in vocab.items()}
        self.first = [0] * 256
        for c, b in letter.items():
            self.first[b] = vocab[c]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        #: Whether ids alone tell the order of merges and nothing but bytes, pieces and merges makes the ids.
        self.plain = self._cuts_plainly(spec) and len(vocab) == 256 + len(self.made) and self.made == sorted(set(self.made)) and max(self.first) < self.made[0]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.piece = regex.compile(PIECE)
        self.cached = lru_cache(100_000)(self._piece)

    @staticmethod
    def _cuts_plainly(spec: dict) -> bool:
        """No normalizer, the usual pieces without a prefix space, no option of the model that changes merges."""
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        return bool(usual) and not spec.get("normalizer") and model["type"] == "BPE" and not any(model.get(x) for x in options)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        first = self.first
        ids = [first[b] for b in data]
        n, rank_of, made = len(ids), self.ranks.get, self.made
        if n == 1:
            return ids
        queue = [r * n + i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]  # rank, then position
        if not queue:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        push, pop = heapq.heappush, heapq.heappop
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(pop(queue), n)
            a, j = ids[i], after[i]
            if a < 0 or j >= n or rank_of(a << 32 | ids[j]) != rank:
                continue  # stale
            new = ids[i] = made[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 32 | ids[k])) is not None:
                    push(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] << 32 | new)) is not None:
                push(queue, r * n + h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        return id_bytes(self.merge(piece.encode()))

    def known(self, piece: str) -> bytes:
        """Ids of a piece as bytes; long pieces are not kept."""
        return self.cached(piece) if len(piece) <= LONGEST else self._piece(piece)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.added):
            return b"".join(map(self.known, self.piece.findall(text)))
        runs = self.cut.split(text)
        return b"".join(id_bytes([self.added[run]]) if run in self.added else b"".join(map(self.known, self.piece.findall(run))) for run in runs if run)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (text of those ids) for every row of `docs` (doc_id, text)."""
    path = path or tokenizer_file()
    bounded_batches(docs.sparkSession)

    def run(batches):
        pairs = BytePairs(path)
        cache = PartCache(pairs.encode)
        for whole in batches:
            for batch in sliced(whole, 1):
                ids = cache.ids(batch.column(1).to_pylist(), tuple(pairs.added))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([pairs.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def op9_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    made = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
