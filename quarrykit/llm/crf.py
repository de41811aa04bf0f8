"""Quality classifier (7): a linear-chain conditional random field over the lines of a text.

Every line has features of its own and of both neighbours; the field labels it bad or good. It is trained by gradient
ascent on at most `SAMPLE` labelled documents (the smallest document hashes) of at most `SAMPLE_BYTES` bytes in all, whose
lines carry the document's label.
A document's quality is the length-weighted mean of its lines' forward-backward marginals, calibrated by a logistic
curve on the same sample.

Defined cases: texts without bytes (null too) have no lines and get the base rate of the sample; documents labelled more
than once count once with their least label, and of rows with one doc_id the least text; without labels every score is
0.5; repeated rows get equal results; an empty table gives no rows; all other columns stay, but `quality_score` is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import sliced, span_counts, text_buffers, word_table
from .langid import fold
from .lines import line_table, repeated
from .shared import bounded_batches, discard, materialize, one_per_id

SAMPLE = 4000  # labelled documents at most from which the field is fitted
SAMPLE_BYTES = 64 << 20  # bytes of text at most from which the field is fitted
_STEPS, _RATE, _L2, _BLOCK = 150, 0.1, 1e-4, 200
_KINDS = (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"|", b"#*$%&<>", b"!?", b".:;", b",", b"-_=+/\\~^@\"'()[]{}")
_KIND = np.full(256, len(_KINDS))
for _i, _chars in enumerate(_KINDS):
    _KIND[list(_chars)] = _i


class Field(NamedTuple):
    weights: np.ndarray  # features, towards "good"
    moves: np.ndarray  # 2 x 2, from label to label
    curve: tuple[float, float]
    base: float


def line_features(raw: np.ndarray, offsets: np.ndarray):
    """(lines, features per line with those of its neighbours): shares of byte classes, word and line lengths, repeats."""
    lines = line_table(raw, offsets)
    size = np.maximum(lines.end - lines.start, 1).astype(float)
    upper, lower, digit, pipe, symbol, bang, stop, comma, other = span_counts(raw, lines.start, _KIND, len(_KINDS)).T
    symbol = symbol + pipe
    table = word_table(raw, offsets)
    within = lambda at: np.searchsorted(at, lines.end, "left") - np.searchsorted(at, lines.start, "left")
    echo = within(table.start[1:][(table.doc[1:] == table.doc[:-1]) & (table.hash[1:] == table.hash[:-1])])
    words = np.maximum(within(table.start), 1)
    rows = [x / size for x in (upper, lower, digit, symbol, bang, stop, comma, other)]
    rows += [np.minimum(x / words, 2) for x in (symbol, bang, digit, pipe)] + [echo / words, (echo > 1).astype(float)]
    rows += [np.minimum(size / words, 20) / 10, np.minimum(np.log1p(size), 10) / 5, repeated(lines).astype(float), (~lines.filled).astype(float), (stop == 0).astype(float)]
    own = np.stack(rows, 1) if len(lines.doc) else np.zeros((0, len(rows)))
    same = lines.doc[1:] == lines.doc[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    edge = np.ones((len(own), 3))
    edge[1:, 1], edge[:-1, 2] = ~same, ~same
    return lines, np.concatenate((own, before, after, edge), 1)


def marginals(score: np.ndarray, moves: np.ndarray, begin: np.ndarray, count: np.ndarray):
    """Forward-backward over all chains at once. Returns P(good) per line and the expected moves summed over chains."""
    n = len(score)
    emit = np.stack((np.zeros(n), score), 1)
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    longest = count[0] if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), "left")
    ahead, back, scale = np.zeros((n, 2)), np.zeros((n, 2)), emit.max(1, initial=0.0)
    e, m = np.exp(emit - scale[:, None]), np.exp(moves - moves.max())
    for t, a in enumerate(active):
        at = begin[:a] + t
        v = e[at] if t == 0 else (ahead[at - 1] @ m) * e[at]
        ahead[at] = v / v.sum(1, keepdims=True)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        back[at] = 1
        if t + 1 < longest:
            b = active[t + 1]
            v = (e[at[:b] + 1] * back[at[:b] + 1]) @ m.T
            back[at[:b]] = v / v.sum(1, keepdims=True)
    p = ahead * back
    p /= p.sum(1, keepdims=True) if n else 1
    inner = np.ones(n, bool)
    if len(begin):
        inner[(begin + count - 1)[count > 0]] = False
    i = np.flatnonzero(inner)
    pairs = ahead[i][:, :, None] * m[None] * (e[i + 1] * back[i + 1])[:, None, :] if len(i) else np.zeros((0, 2, 2))
    return p[:, 1], (pairs / pairs.sum((1, 2), keepdims=True)).sum(0) if len(i) else np.zeros((2, 2))


def _pooled(p: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(doc, size, minlength=n)
    return np.bincount(doc, size * p, minlength=n) / np.maximum(total, 1e-9)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[str | None], labels: list[int]) -> Field:
    """Gradient ascent (Adam) on the field's log-likelihood, then the calibration curve."""
    n = len(texts)
    y = np.array(labels, float)
    if not n:
        return Field(np.zeros(0), np.zeros((2, 2)), (1.0, 0.0), 0.5)
    made = []
    for a in range(0, n, _BLOCK):  # in blocks: the byte arrays of a block are much larger than its features
        lines, part = line_features(*text_buffers(pa.array(texts[a : a + _BLOCK], pa.large_string())))
        made.append((lines.doc + a, (lines.end - lines.start + 1).astype(float), part))
    doc, size, x = (np.concatenate(c) for c in zip(*made, strict=True))
    base = float(np.clip(y.mean(), 0.01, 0.99))
    count = np.bincount(doc, minlength=n)
    begin = np.cumsum(count) - count
    truth = y[doc]
    same = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:-1][same].astype(int), truth[1:][same].astype(int)), 1)
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
    for step in range(1, _STEPS + 1):
        p, expected = marginals(x @ w, moves, begin, count)
        g = np.concatenate((x.T @ (truth - p), (seen - expected).ravel())) / max(len(truth), 1) - _L2 * np.concatenate((w, moves.ravel()))
        state = [0.9 * state[0] + 0.1 * g, 0.99 * state[1] + 0.01 * g * g]
        move = _RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
    has = count > 0
    z = _logit(_pooled(marginals(x @ w, moves, begin, count)[0], size, doc, n))[has]
    a, b = 1.0, 0.0
    for _ in range(300):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a += 0.05 * float(((y[has] - q) * z).mean() - 0.001 * a)
        b += 0.05 * float((y[has] - q).mean())
    return Field(w, moves, (a, b), base)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Fits on the labelled documents with the smallest hashes of their doc_id, at most `sample` of at most `sample_bytes`.

    A text that no longer fits in these bytes is passed over, and the next ones are still taken.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.where(fold() != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = materialize(one_per_id(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")), "sample")
    sizes = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()  # `sample` rows
    taken, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if total + r["size"] <= sample_bytes:
            total += r["size"]
            taken.append(r["doc_id"])
    wanted = docs.sparkSession.createDataFrame(pa.table({"doc_id": taken}), rows.select("doc_id").schema)  # rows of Python would leave idle workers
    kept = rows.join(F.broadcast(wanted), "doc_id").orderBy("doc_id").collect() if taken else []
    made = fit([r["text"] for r in kept], [int(r["quality"] > 0) for r in kept])
    discard(rows)
    return made


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with quality_score: the calibrated, length-weighted share of good lines."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for batch in sliced(whole, at):
                raw, offsets = text_buffers(batch.column(at))
                n = batch.num_rows
                out = np.full(n, field.base)
                if len(raw) and len(field.weights):
                    lines, x = line_features(raw, offsets)
                    count = np.bincount(lines.doc, minlength=n)
                    p, _ = marginals(x @ field.weights, field.moves, np.cumsum(count) - count, count)
                    z = _logit(_pooled(p, (lines.end - lines.start + 1).astype(float), lines.doc, n))
                    has = count > 0
                    out[has] = (1 / (1 + np.exp(-np.clip(field.curve[0] * z + field.curve[1], -30, 30))))[has]
                yield batch.append_column("quality_score", pa.array(out))

    docs = docs.drop("quality_score")
    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["quality_score double"]))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = score_documents(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = F.col("quality_score")
    return made.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
