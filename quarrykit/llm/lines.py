"""Lines of a batch of texts at once: bounds, hashes and byte-class counts."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .kernels import U64, mix, span_sums, word_bounds

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


class Lines(NamedTuple):
    """All \\n-split lines in order: text index, byte start and end, hash, and whether a word is in it."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    filled: np.ndarray


def line_table(raw: np.ndarray, offsets: np.ndarray) -> Lines:
    """Empty texts have no lines; every other text has one more line than line feeds."""
    breaks = np.flatnonzero(raw == 10)
    full = np.diff(offsets) > 0
    start = np.sort(np.concatenate((offsets[:-1][full], breaks + 1)))
    end = np.sort(np.concatenate((offsets[1:][full], breaks)))
    doc = np.repeat(np.arange(len(full)), np.where(full, np.diff(np.searchsorted(breaks, offsets)) + 1, 0))
    h = mix(span_sums(raw, start, end) + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    first = word_bounds(raw, offsets)[0]
    return Lines(doc, start, end, h, np.searchsorted(first, end, "left") > np.searchsorted(first, start, "left"))


def repeated(lines: Lines) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    key = mix(lines.hash ^ mix(lines.doc.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again & lines.filled
