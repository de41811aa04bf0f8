"""Terms of whole texts: maximal runs of letters (and digits) and of all characters beyond ASCII, A-Z lower-cased.

As only ASCII characters divide, UTF-8 bytes are cut without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from .kernels import LOWER

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[0x30:0x3A] = True
PIECE = 4 << 20  # bytes of text that are cut into terms at once


class TermCounts(NamedTuple):
    """How often each term occurs in each text: sorted by text, one entry for each of its terms."""

    doc: np.ndarray
    term: np.ndarray  # index into `words`
    tf: np.ndarray
    words: pa.Array
    length: np.ndarray  # terms of each text, with repeats


def term_array(raw: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts laid end to end, and the text that each is from."""
    inside = kept[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a term may begin or end here
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=at[1:])
    data = LOWER[raw[inside]]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(data)), np.searchsorted(offsets, start, "right") - 1


def cell_sums(cell: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different cells in order and the sum of each of `values` (or the number of entries, without any) in them."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    if not values:
        return cell[first], np.diff(np.append(first, len(cell)))
    return cell[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _counts(raw: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> TermCounts:
    found, doc = term_array(raw, offsets, kept)
    coded = found.dictionary_encode()
    n = max(1, len(coded.dictionary))
    cell, tf = cell_sums(doc * n + coded.indices.to_numpy())
    return TermCounts(*np.divmod(cell, n), tf, coded.dictionary, np.bincount(doc, minlength=len(offsets) - 1))


def _stretches(raw: np.ndarray, kept: np.ndarray) -> Iterator[np.ndarray]:
    """A text in stretches of about `PIECE` bytes that end between terms."""
    at = 0
    while at < len(raw):
        to = min(at + PIECE, len(raw))
        while to < len(raw) and kept[raw[to]]:  # a term goes on: the stretch ends where it does
            rest = np.flatnonzero(~kept[raw[to : to + PIECE]])
            to = to + int(rest[0]) if len(rest) else min(to + PIECE, len(raw))
        yield raw[at:to]
        at = to


def count_terms(raw: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> TermCounts:
    """Counts of a batch of texts; one text longer than `PIECE` is counted stretch by stretch."""
    if len(raw) <= PIECE or len(offsets) != 2:
        return _counts(raw, offsets, kept)
    table, length = None, 0
    for part in _stretches(raw, kept):
        made = _counts(part, np.array([0, len(part)]), kept)
        length += int(made.length[0])
        now = pa.table({"term": made.words.take(pa.array(made.term)), "tf": made.tf})
        table = now if table is None else pa.concat_tables([table, now]).group_by("term").aggregate([("tf", "sum")]).rename_columns(["term", "tf"])
    words = table["term"].combine_chunks()
    return TermCounts(np.zeros(len(words), np.int64), np.arange(len(words)), table["tf"].to_numpy().astype(np.int64), words, np.array([length]))


def batches_of(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `PIECE` bytes each; a longer text is alone."""
    size, a = np.diff(offsets), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        yield a, b
        a = b
