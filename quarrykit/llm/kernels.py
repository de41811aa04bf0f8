"""Vectorised text kernels on Arrow string buffers: words, word hashes and k-word hashes of a whole batch at once.

Words are `[^\\x20\\x09-\\x0D]+`; as the delimiters are ASCII, UTF-8 bytes are cut without decoding. Hashes are 64-bit
and depend on nothing but the words, so they agree between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_P, _A, _B = U64(0x9E6D62D06F6A9A9B), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_PINV = U64(pow(int(_P), -1, 1 << 64))
_CHUNK = 1 << 18
_SLICE = 1 << 20

DELIMITER = np.zeros(256, bool)
DELIMITER[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
LOWER = _SAME.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and the n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_steps = [np.full(_CHUNK + 1, base, U64) for base in (_P, _PINV)]
for _s in _steps:
    _s[0] = 1
_UP, _DOWN = (np.multiply.accumulate(_s) for _s in _steps)
del _steps, _s


def pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of bounded length."""
    for at in range(0, len(raw), _CHUNK):
        yield at, min(at + _CHUNK, len(raw))


def span_sums(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = _SAME) -> np.ndarray:
    """Polynomial sum modulo 2**64 of the bytes of each span; spans are sorted and do not overlap.

    Works in pieces of `_CHUNK` bytes, so that memory does not follow the length of a text or of a single word.
    """
    out = np.zeros(len(start), U64)
    sums = np.zeros(min(len(raw), _CHUNK) + 1, U64)
    for at, to in pieces(raw):
        n = to - at
        np.cumsum((fold[raw[at:to]].astype(U64) + U64(1)) * _UP[:n], out=sums[1 : n + 1])
        i, j = np.searchsorted(start, (at, to), "left")
        a = start[i:j] - at
        out[i:j] = (sums[np.minimum(end[i:j], to) - at] - sums[a]) * _DOWN[a]
        if i and end[i - 1] > at:  # the span that goes on from the piece before
            out[i - 1 : i] += sums[min(end[i - 1], to) - at : min(end[i - 1], to) - at + 1] * U64(pow(int(_P), int(at - start[i - 1]), 1 << 64))
    return out


def span_counts(raw: np.ndarray, start: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    """Bytes of kinds 0 to n-1 (a table of 256 kinds; kind n is not counted) from each span's start to the next one's."""
    out = np.zeros((len(start), n), np.int64)
    for at, to in pieces(raw):
        i, j = np.searchsorted(start, (at, to), "left")
        owner = np.cumsum(np.bincount(start[i:j] - at, minlength=to - at))
        made = np.bincount(owner * (n + 1) + kind[raw[at:to]], minlength=(j - i + 1) * (n + 1)).reshape(-1, n + 1)[:, :n]
        if i:
            out[i - 1] += made[0]
        out[i:j] += made[1:]
    return out


class Words(NamedTuple):
    """All words of a batch in order: hash, index of the text, byte start and end."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def counts(self, n_docs: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n_docs)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of texts laid end to end."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at, to in pieces(raw):
        word = np.zeros(to - at + 2, bool)  # with one byte before and one after
        word[1:-1] = ~DELIMITER[raw[at:to]]
        word[0] = at > 0 and not DELIMITER[raw[at - 1]]
        word[-1] = to < len(raw) and not DELIMITER[raw[to]]
        begins, ends = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        i, j, k = np.searchsorted(offsets, (at, to, to + 1), "left")
        first = offsets[i:j] - at
        begins[first] = word[1:-1][first]
        last = offsets[i:k] - at - 1
        last = last[last >= 0]
        ends[last] = word[1:-1][last]
        out.append((np.flatnonzero(begins) + at, np.flatnonzero(ends) + at + 1))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def word_table(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of texts laid end to end."""
    start, end = word_bounds(raw, offsets)
    h = mix(span_sums(raw, start, end, LOWER if lower else _SAME) + (end - start).astype(U64) * _A)
    return Words(h, np.searchsorted(offsets, start, "right") - 1, start, end)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + (b ^ (b >> U64(31))) * _B
    x ^= x >> U64(32)
    return x * _P


def k_word_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (all positions, across texts; the caller drops windows over an edge)."""
    if len(h) < k:
        return np.zeros(0, U64)
    total, width, made, bits = None, 0, h, 1
    while bits <= k:
        if k & bits:
            part = made[width:]
            m = len(h) - k + 1
            total = part[:m] if total is None else _pair(total[:m], part[:m])
            width += bits
        bits <<= 1
        if bits <= k:
            half = bits >> 1
            made = _pair(made[: len(made) - half], made[half:])
    return mix(total + U64(k))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index and position in the text of every window of k words within one text."""
    h = k_word_hash(words.hash, k)
    doc = words.doc[: len(h)]
    inside = doc == words.doc[k - 1 : k - 1 + len(h)]
    first = np.concatenate(([True], words.doc[1:] != words.doc[:-1])) if len(words.doc) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    pos = (np.arange(len(first)) - begin)[: len(h)]
    return h[inside], doc[inside], pos[inside]


def shingle_sets(words: Words, n_docs: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per text its sorted distinct k-word shingles; a text with fewer words is one shingle, without words none."""
    h = k_word_hash(words.hash, k)
    count = words.counts(n_docs)
    begin = np.concatenate(([0], np.cumsum(count)))
    for i in range(n_docs):
        a, n = begin[i], count[i]
        if n >= k:
            s = np.sort(h[a : a + n - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield i, s
        elif n:
            yield i, k_word_hash(words.hash[a : a + n], int(n))
        else:
            yield i, h[:0]


def sliced(batch: pa.RecordBatch, column: int, most: int = _SLICE):
    """Parts of a batch with about `most` bytes of text each, so that a task's memory stays bounded."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """All rows in batches of about `most` bytes of text, whatever the size of those that come in."""
    held, size = [], 0
    for batch in (part for whole in batches for part in sliced(whole, column, most)):
        more = pa.compute.sum(pa.compute.binary_length(batch.column(column))).as_py() or 0
        if held and size + more > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def packed(a: np.ndarray, kind=None) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def unpacked(column, kind: str) -> np.ndarray:
    """The numbers of a whole column of `packed` values, laid end to end."""
    return text_buffers(column)[0].view(kind)
