"""Language ID (2): script ranges narrow the candidates, Viterbi over per-word scores labels spans of mixed text.

Learning counts hashed byte trigrams of words and the scripts of words by language, over all learning rows; the counts
have a fixed size per language. A word's score for a language is the sum of its trigrams' centred log-likelihoods;
languages that hardly ever write in the word's script are ruled out for it. Viterbi finds the best labelling of a text's
words when every change of language costs `SWITCH`. A text's language is the one with most letters in its spans.

Defined cases: null texts and texts without any letter are `und` with score 0; ties go to the language that sorts
first; without any learning row everything is `und`; repeated rows get equal results; an empty table gives no rows; other
columns stay, but those named lang_pred, score and spans are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import DELIMITER, LOWER, Words, packed, pieces, sliced, span_counts, text_buffers, word_table
from .shared import bounded_batches

CELL_BITS = 15
SWITCH = 12.0  # nats that a change of language within a text costs
RARE = 1e-4  # share of a language's words below which a script counts as foreign to it
RULED_OUT = -60.0

#: Fixed: lead bytes of UTF-8 by script range (ASCII letters are Latin).
SCRIPTS = {"latin": (0xC3, 0xC9), "greek": (0xCD, 0xCF), "cyrillic": (0xD0, 0xD4), "hebrew": (0xD6, 0xD7), "arabic": (0xD8, 0xDD), "indic": (0xE0, 0xE0), "other": (0xE1, 0xE2), "kana": (0xE3, 0xE3), "han": (0xE4, 0xE9), "hangul": (0xEA, 0xED)}
_SCRIPT = np.zeros(256, np.uint16)
for _i, (_a, _b) in enumerate(SCRIPTS.values()):
    _SCRIPT[_a : _b + 1] = 1 << _i
_SCRIPT[65:91] = _SCRIPT[97:123] = 1
_NO_LETTER = (_SCRIPT == 0).astype(np.int64)  # kind 0: letters
_PLAIN = np.where(DELIMITER, np.uint8(32), LOWER).astype(np.uint32)
_N = len(SCRIPTS)


class Model(NamedTuple):
    langs: list[str]
    score: np.ndarray  # languages x cells
    allowed: np.ndarray  # scripts x languages


def _cells(raw: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """The trigram cells of bytes a to b; a text's ends count as spaces."""
    low = np.full(b - a + 2, 32, np.uint32)
    lo, hi = max(a - 1, 0), min(b + 1, len(raw))
    low[lo - a + 1 : hi - a + 1] = _PLAIN[raw[lo:hi]]
    before, after = low[:-2].copy(), low[2:].copy()
    i, j = np.searchsorted(offsets, (a, b), "left")
    before[offsets[i:j] - a] = 32
    i, j = np.searchsorted(offsets, (a, b), "right")
    after[offsets[i:j] - 1 - a] = 32
    return ((before << 16 | low[1:-1] << 8 | after) * np.uint32(2654435761)) >> np.uint32(32 - CELL_BITS)


def _scripts(raw: np.ndarray, words: Words) -> np.ndarray:
    """Each word's script (the last in the table that occurs in it) or -1."""
    bits = np.zeros(len(words.start), np.uint16)
    for a, b in pieces(raw):
        i, j = np.searchsorted(words.start, (a, b))
        found = np.bitwise_or.reduceat(_SCRIPT[raw[a:b]], np.append(0, words.start[i:j] - a))  # white space has no script
        if i and words.end[i - 1] > a:
            bits[i - 1] |= found[0]
        bits[i:j] = found[1:]
    return np.where(bits > 0, np.floor(np.log2(np.maximum(bits, 1))).astype(np.int64), -1)


def learn(docs: DataFrame) -> Model:
    """From `docs` (text, lang), every row with a language. The counts are of fixed size per language."""

    def count(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for batch in sliced(whole, 0):
                raw, offsets = text_buffers(batch.column(0))
                if not len(raw):
                    continue
                words = word_table(raw, offsets)
                script = _scripts(raw, words)
                codes = batch.column(1).dictionary_encode()
                names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
                lang = of[words.doc]
                made = np.zeros(len(names) << CELL_BITS, np.int64)
                for a, b in pieces(raw):
                    i, j = np.searchsorted(offsets, (a, b))
                    owner = np.repeat(of[max(i - 1, 0) : j], np.diff(np.concatenate(([a] if i else [], offsets[i:j], [b])).astype(np.int64)))
                    made += np.bincount((owner << CELL_BITS) + _cells(raw, offsets, a, b), ~DELIMITER[raw[a:b]], minlength=len(made)).astype(np.int64)
                for i, name in enumerate(names):
                    cells, scripts = total.setdefault(name, (np.zeros(1 << CELL_BITS, np.int64), np.zeros(_N, np.int64)))
                    cells += made[i << CELL_BITS : (i + 1) << CELL_BITS]
                    scripts += np.bincount(script[(lang == i) & (script >= 0)], minlength=_N)
        for name, (cells, scripts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed(np.concatenate((cells, scripts)), "<i8")], pa.binary())], ["lang", "counts"])

    def add(group: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(x, "<i8") for x in group["counts"].to_pylist()], axis=0)
        return pa.table({"lang": group["lang"][:1], "counts": pa.array([packed(s, "<i8")], pa.binary())})

    bounded_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, counts binary")
    rows = sorted(rows.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect())  # one row per language
    langs = [r[0] for r in rows]
    counts = np.array([np.frombuffer(r[1], "<i8") for r in rows], float).reshape(len(rows), (1 << CELL_BITS) + _N)
    cells, scripts = counts[:, : 1 << CELL_BITS], counts[:, 1 << CELL_BITS :]
    logp = np.log((cells + 0.5) / (cells.sum(1, keepdims=True) + 0.5 * cells.shape[1])) if langs else cells
    score = logp - logp.mean(0, keepdims=True) if langs else logp
    allowed = (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= RARE).T
    return Model(langs, np.ascontiguousarray(score, np.float32), allowed)


def viterbi(scores: np.ndarray, begin: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each row of `scores` (rows of sequence i: begin[i] .. begin[i]+count[i]); all sequences at once."""
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    n, k = scores.shape
    best, moved = np.zeros(n, np.int32), np.zeros((n, k), bool)
    value = np.zeros((len(begin), k))
    active = np.searchsorted(-count, -np.arange(count[0] if len(count) else 0), "left")  # sequences longer than t
    for t, a in enumerate(active):
        at, v = begin[:a] + t, value[:a]
        if t:
            top = v.argmax(1)
            reach = v[np.arange(a), top] - switch
            jump = v < reach[:, None]
            best[at], moved[at] = top, jump
            np.maximum(v, reach[:, None], out=v)
        v += scores[at]
    label, state = np.zeros(n, np.int32), value.argmax(1).astype(np.int32) if len(begin) else np.zeros(0, np.int32)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at, s = begin[:a] + t, state[:a]
        label[at] = s
        if t:
            s[:] = np.where(moved[at, s], best[at], s)
    return label


def _word_scores(raw: np.ndarray, offsets: np.ndarray, words: Words, model: Model) -> np.ndarray:
    out = np.zeros((len(words.start), len(model.langs)), np.float32)
    for a, b in pieces(raw):
        i, j = np.searchsorted(words.start, (a, b))
        i -= int(i > 0 and words.end[i - 1] > a)
        cell, sums = _cells(raw, offsets, a, b), np.zeros(b - a + 1)
        start, end = np.maximum(words.start[i:j], a) - a, np.minimum(words.end[i:j], b) - a
        for k, score in enumerate(model.score):
            np.cumsum(score[cell], out=sums[1:])
            out[i:j, k] += sums[end] - sums[start]
    script = _scripts(raw, words)
    plain = script < 0
    out[plain] = 0
    fits = model.allowed[np.maximum(script, 0)]
    fits[plain | ~fits.any(1)] = True
    out[~fits] = RULED_OUT
    return out


def label_texts(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """`docs` with lang_pred, score (share of its letters in lang_pred) and, if asked for, spans (lang, first word, words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
    out_spans = spans

    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in sliced(whole, batch_text := whole.schema.get_field_index("text")):
                raw, offsets = text_buffers(batch.column(batch_text))
                n = batch.num_rows
                share, parts = np.zeros((n, max(1, len(model.langs)))), [[] for _ in range(n)]
                if len(raw) and model.langs:
                    words = word_table(raw, offsets)
                    count = words.counts(n)
                    begin = np.cumsum(count) - count
                    label = viterbi(_word_scores(raw, offsets, words, model), begin, count)
                    letters = span_counts(raw, words.start, _NO_LETTER, 1)[:, 0]
                    share = np.bincount(words.doc * len(model.langs) + label, letters, minlength=n * len(model.langs)).reshape(n, -1)
                    if out_spans and len(label):
                        cut = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1]))))
                        for a, m in zip(cut, np.diff(np.append(cut, len(label))), strict=True):
                            d = words.doc[a]
                            parts[d].append({"lang": model.langs[label[a]], "first_word": int(a - begin[d]), "n_words": int(m)})
                top = share.argmax(1)
                letters = share.sum(1)
                ok = np.array(batch.column(batch.schema.get_field_index("__letters")).fill_null(False).to_pylist(), bool) & bool(model.langs)
                pred = [model.langs[t] if o else "und" for t, o in zip(top, ok, strict=True)]
                score = np.where(ok, np.where(letters > 0, share.max(1) / np.maximum(letters, 1), 1 / max(1, len(model.langs))), 0.0)
                made = batch.drop_columns(["__letters"]).append_column("lang_pred", pa.array(pred)).append_column("score", pa.array(score))
                yield made.append_column("spans", pa.array(parts, kind)) if out_spans else made

    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "spans")
    marked = docs.withColumn("__letters", F.col("text").rlike("\\p{L}"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double"]
    fields += ["spans array<struct<lang:string,first_word:bigint,n_words:bigint>>"] * spans
    return marked.mapInArrow(run, ", ".join(fields))


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3


def identify(docs: DataFrame, spans: bool = True) -> DataFrame:
    """Learns from the rows of `docs` with a language outside the held-out third, and labels all rows."""
    return label_texts(docs, learn(docs.where(fold() != 1)), spans)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    made = label_texts(docs.select("doc_id", "text"), learn(docs.where(fold() != 1)))
    return made.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
