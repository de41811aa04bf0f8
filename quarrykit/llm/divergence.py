"""Quality rules (6): Jensen-Shannon distance of character classes and common words to language references.

References are the summed histograms of all documents of a language: character classes, and hashed words, of which the
`COMMON` most frequent cells count as that language's common words (all others are one bin). A text is compared with its
nearest language. It goes if its character distance is over `CHAR_LIMIT`, or its word distance over `WORD_LIMIT`, each
plus a guard that shrinks with the text's length; texts under `MIN_WORDS` words are not judged by divergence.

Base rules: under 50 words, or more than half of the words in repeated 3-word windows, fail.

Defined cases: null text has no words (fails the base rules); documents without a language feed no reference; without
any reference only the base rules decide; repeated rows get equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import DELIMITER, U64, Words, k_word_hash, mix, packed, sliced, span_counts, text_buffers, word_table
from .lines import SYMBOLS, line_table, repeated
from .shared import bounded_batches

COMMON, CELL_BITS = 64, 14
MIN_WORDS, CHAR_LIMIT, WORD_LIMIT = 50, 0.28, 0.40
CHAR_GUARD, WORD_GUARD = 0.3, 0.7  # over the square root of the number of words: what sampling alone adds
#: Fixed: byte classes. 0 lower, 1 upper, 2 digit, 3 space, 4 other white space, 5 full stop, 6 comma, 7 ! and ?,
#: 8 symbols, 9 other ASCII, 10 Latin-1 marks, 11 other Latin letters, 12 other scripts; 13 continuation (not counted).
_CLASS = np.full(256, 9, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[9:14] = 0, 1, 2, 3, 4
_CLASS[ord(".")], _CLASS[ord(",")], _CLASS[[33, 63]], _CLASS[SYMBOLS] = 5, 6, 7, 8
_CLASS[0xC2], _CLASS[0xC3:0xCA], _CLASS[0xCA:256], _CLASS[0x80:0xC0] = 10, 11, 12, 13
_N = 13
#: 0: symbols, 1: other first bytes of word characters, 2: white space and continuation bytes.
_MARKS = np.where(SYMBOLS, 0, np.where(DELIMITER | (np.arange(256) & 0xC0 == 0x80), 2, 1))


class References(NamedTuple):
    langs: list[str]
    chars: np.ndarray  # languages x classes, shares
    words: np.ndarray  # languages x (COMMON + 1), shares
    bins: np.ndarray  # languages x cells: bin of a word cell


def _cells(words: Words) -> np.ndarray:
    return (words.hash >> U64(64 - CELL_BITS)).astype(np.int64)


def _classes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return span_counts(raw, offsets[:-1], _CLASS, _N)


def references(docs: DataFrame) -> References:
    """From every row of `docs` (text, lang) with a language; the summed counts have a fixed size per language."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in sliced(whole, 0):
                raw, offsets = text_buffers(batch.column(0))
                codes = batch.column(1).dictionary_encode()
                of = codes.indices.to_numpy(zero_copy_only=False)
                words, chars = word_table(raw, offsets), _classes(raw, offsets)
                cells = _cells(words)
                for i, name in enumerate(codes.dictionary.to_pylist()):
                    made = np.concatenate((chars[of == i].sum(0), np.bincount(cells[of[words.doc] == i], minlength=1 << CELL_BITS)))
                    total[name] = total.get(name, 0) + made
        for name, made in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed(made, "<i8")], pa.binary())], ["lang", "counts"])

    def add(group: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(x, "<i8") for x in group["counts"].to_pylist()], axis=0)
        return pa.table({"lang": group["lang"][:1], "counts": pa.array([packed(s, "<i8")], pa.binary())})

    bounded_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("text", "lang")
    rows = known.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary")
    rows = sorted(((r[0], np.frombuffer(r[1], "<i8")) for r in rows.collect()), key=lambda r: r[0])  # one row per language
    return reference_table([r[0] for r in rows], [r[1] for r in rows])


def reference_table(langs: list[str], counts: list[np.ndarray]) -> References:
    chars, words, bins = [], [], []
    for c in counts:
        cells = c[_N:]
        top = np.argsort(-cells, kind="stable")[:COMMON]
        of = np.full(len(cells), COMMON)
        of[top] = np.arange(len(top))
        bins.append(of)
        chars.append(c[:_N] / max(c[:_N].sum(), 1))
        hist = np.bincount(of, cells, minlength=COMMON + 1)
        words.append(hist / max(hist.sum(), 1))
    return References(langs, np.array(chars).reshape(-1, _N), np.array(words).reshape(-1, COMMON + 1), np.array(bins).reshape(-1, 1 << CELL_BITS))


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts to one distribution; 1 for an empty row."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(1)
        d = np.sqrt(np.maximum(0, (part(p) + part(np.broadcast_to(reference, p.shape))) / 2))
    return np.where(total[:, 0] > 0, d, 1.0)


def base_counts(raw: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    n = len(offsets) - 1
    marks = span_counts(raw, offsets[:-1], _MARKS, 2)
    count = words.counts(n)
    lines = line_table(raw, offsets)
    dups = np.bincount(lines.doc[repeated(lines)], minlength=n)
    covered = np.zeros(len(words.doc), bool)
    h = k_word_hash(words.hash, 3)
    if len(h):
        at = np.flatnonzero(words.doc[: len(h)] == words.doc[2:])
        key = mix(h[at] ^ mix(words.doc[at].astype(U64) + U64(7)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        many = at[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]] if len(at) else at
        for k in range(3):
            covered[many + k] = True
    return {
        "n_words": count,
        "word_chars": marks.sum(1),
        "n_symbols": marks[:, 0],
        "n_dup_lines": dups,
        "n_repeat_words": np.bincount(words.doc[covered], minlength=n),
    }


def judge(docs: DataFrame, refs: References, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, nearest_lang, char_distance, word_distance for every row of `docs`."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches):
        refs = shared.value
        for whole in batches:
            for batch in sliced(whole, 1):
                raw, offsets = text_buffers(batch.column(1))
                n = batch.num_rows
                words = word_table(raw, offsets)
                base = base_counts(raw, offsets, words)
                count = base["n_words"]
                failed = (count < 50) | (100 * base["n_repeat_words"] > 50 * count)
                near, char, word = np.full(n, -1), np.zeros(n), np.zeros(n)
                if refs.langs:
                    chars, cells = _classes(raw, offsets), _cells(words)
                    cd = np.stack([js_distance(chars, r) for r in refs.chars], 1)
                    wd = np.stack([js_distance(np.bincount(words.doc * (COMMON + 1) + of[cells], minlength=n * (COMMON + 1)).reshape(n, -1), r) for of, r in zip(refs.bins, refs.words, strict=True)], 1)
                    near = (cd + wd).argmin(1)
                    char, word = cd[np.arange(n), near], wd[np.arange(n), near]
                root = np.sqrt(np.maximum(count, 1))
                strange = (count >= min_words) & ((char > char_limit + CHAR_GUARD / root) | (word > word_limit + WORD_GUARD / root))
                cols = [pa.array(base[c], pa.int64()) for c in base]
                langs = pa.array([refs.langs[i] if i >= 0 else None for i in near], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(failed), pa.array(~failed & ~strange), langs, pa.array(char), pa.array(word)], ["doc_id", *base, "base_failed", "kept", "nearest_lang", "char_distance", "word_distance"])

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, kept boolean, nearest_lang string, char_distance double, word_distance double")


def op6_distribution_divergence(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, references(docs))
