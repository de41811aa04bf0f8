"""Media columns (10): payloads stored as lossless WebP, read back as pixel arrays, with features of the pixels.

A value is one image of 64 columns, or several one after the other where the payload has more rows than the format allows.

Defined cases: null text is empty, an empty payload is 64 zero bytes; repeated rows get equal results; an empty table
gives no rows; `encode_media` reads doc_id and text only, `decode_media` keeps other columns than those that it makes.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import sliced, text_buffers
from .shared import bounded_batches
from .webp import encode_samples, images

UNIT = 64
DECODED = 1 << 20  # bytes of payloads that are held decoded at once


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy and a 64-bit gradient hash of the first channel's samples."""
    n = samples.size
    share = np.bincount(samples.ravel(), minlength=256) / n
    mean = float(share @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, share @ (np.arange(256) - mean) ** 2)))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    at = np.arange(66) * n // 65
    cells = np.add.reduceat(samples.ravel(), at[:-1], dtype=np.int64) if n >= 65 else np.zeros(65, np.int64)
    size = at[1:] - at[:-1] if n >= 65 else np.ones(65, np.int64)
    hash_ = np.packbits(cells[1:] * size[:-1] > cells[:-1] * size[1:]).tobytes().hex()
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} deviation={deviation:.4f} entropy={entropy:.4f} gradient={hash_}"


def encode_media(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media: each text's UTF-8, padded with bytes 0, as a lossless WebP file."""

    def run(batches):
        for whole in batches:
            for batch in sliced(whole, 1):
                raw, offsets = text_buffers(batch.column(1))
                rows = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    size = max(unit, -(-(b - a) // unit) * unit)
                    samples = np.zeros(size, np.uint8)
                    samples[: b - a] = raw[a:b]
                    rows.append((int(b - a), int(size), encode_samples(samples)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "payload_bytes", "media"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def by_payload(batch: pa.RecordBatch, size: int, most: int = DECODED):
    """Parts of a batch whose payloads (bytes in column `size`) are about `most` bytes together, or one larger payload."""
    part = np.cumsum(batch.column(size).to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def decode_media(media: DataFrame) -> DataFrame:
    """`media` with payload (the samples read back), width, height and feature. Works on any lossless WebP column.

    Stored forms may be a small part of their payloads, so parts of a batch are cut by `payload_bytes`.
    """

    def run(batches):
        for whole in batches:
            at, size = whole.schema.get_field_index("media"), whole.schema.get_field_index("payload_bytes")
            for batch in by_payload(whole, size):
                rows = []
                for data, n in zip(batch.column(at), batch.column(size), strict=True):
                    samples = np.concatenate([pixels[..., 2] for pixels in images(data.as_py())])
                    rows.append((samples.tobytes()[: n.as_py()], samples.shape[1], samples.shape[0], features(samples)))
                cols = list(zip(*rows, strict=True))
                for name, c, t in zip(("payload", "width", "height", "feature"), cols, (pa.binary(), pa.int32(), pa.int32(), pa.string()), strict=True):
                    batch = batch.append_column(name, pa.array(c, t))
                yield batch

    media = media.drop("payload", "width", "height", "feature")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema] + ["payload binary, width int, height int, feature string"]
    return media.mapInArrow(run, ", ".join(fields))


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    made = decode_media(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    tail = F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})"))
    digests = [F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    return made.select("doc_id", "n_bytes", "payload_bytes", *digests, "feature")
