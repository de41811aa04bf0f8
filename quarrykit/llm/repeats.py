"""Substring dedup (5): repeated k-word edges of a De Bruijn graph, compacted into paths and checked at their source.

An edge is a window of k consecutive words, a node the k-1 words between two edges. Edges that start in a document
with a smaller doc_id are *repeated*; the smallest such document is the edge's source.

1. `repeated_edges`: every task hashes its windows, settles those that repeat inside its batch (the batch's first
   document is their source) and sends one occurrence of each edge, packed in binary rows, to the edge's bin. Edges that
   repeat are remembered within the task, so a hot edge reaches its bin about once per task, however many documents hold
   it. Bins find the smallest document of each edge.
2. `walks`: a document's consecutive repeated edges that also follow each other in the source make one segment.
3. `compact_paths`: segments that follow each other in a document meet at a node; where no other segment enters or
   leaves it, the node does not branch and both become one path (joins with pointer doubling). `path_spans` then joins a
   document's segments of one path to one long span with its route (segments with their source coordinates).
4. `verified`: one occurrence of each route is compared segment by segment with the words at the source coordinates,
   every other one as a whole with that occurrence, by SHA-256. Two different windows of one hash show here; spans that
   fail are settled by their words themselves (`settled_by_words`).
5. `remove_repeats`: words covered by a verified span go.

Bins grow with the input, so a bin's size stays the same at any scale.

Defined cases: null text has no words; null doc_id takes no part and is kept whole; rows of one doc_id are never each
other's source, and spans belong to (doc_id, text), so repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U64, gathered, mix, packed, text_buffers, unpacked, windows, word_table
from .shared import bins_for, bounded_batches, discard, materialize

_PACK = "bin int, keys binary, doc binary, fp binary, cnt binary, pos binary, src binary, diag binary"
_FIELDS = pa.schema([("bin", pa.int32()), *((n, pa.binary()) for n in ("keys", "doc", "fp", "cnt", "pos", "src", "diag"))])
_BATCH = 2 << 20  # bytes of text whose windows are settled at once
_KNOWN = 1 << 16  # repeated edges that a task remembers
_SEGMENT = "doc_id long, fp long, start long, n long, src long, src_start long"


def _rows(bins, keys, doc, fp, pos, src=None, diag=None) -> pa.RecordBatch:
    """One packed row per bin of occurrences that are sorted by (bin, doc, pos). Runs of a document are stored once."""
    cuts = np.flatnonzero(np.diff(bins)) + 1
    out: dict[str, list] = {n: [] for n in _FIELDS.names}
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bins)])), strict=True):
        if a == b:
            continue
        d, f, p = doc[a:b], fp[a:b], pos[a:b]
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (f[1:] != f[:-1]))))
        step = np.diff(p, prepend=0)
        step[new] = p[new]
        out["bin"].append(int(bins[a]))
        out["keys"].append(None if keys is None else packed(keys[a:b]))
        out["doc"].append(packed(d[new], "<i8"))
        out["fp"].append(packed(f[new], "<i8"))
        out["cnt"].append(packed(np.diff(np.append(new, b - a)), "<i4"))
        out["pos"].append(np.ascontiguousarray(step, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes())
        out["src"].append(None if src is None else packed(src[a:b], "<i8"))
        out["diag"].append(None if diag is None else packed(diag[a:b], "<i4"))
    return pa.RecordBatch.from_pydict(out, schema=_FIELDS)


def _unpack(doc: bytes, fp: bytes, cnt: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(cnt, "<i4")
    step = np.ascontiguousarray(np.frombuffer(pos, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
    new = np.concatenate(([0], np.cumsum(n)[:-1]))
    total = np.cumsum(step)
    base = np.repeat(total[new] - step[new], n)
    return np.repeat(np.frombuffer(doc, "<i8"), n), np.repeat(np.frombuffer(fp, "<i8"), n), total - base


def _met_again(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    order = np.argsort(key, kind="stable")
    ks = key[order]
    same = ks[1:] == ks[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _occurrences(table: pa.Table, keep: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Document, text hash and position of the packed occurrences, only of those to `keep`: a row at a time is unpacked whole."""
    out, at = [], 0
    for row in zip(*(table[c] for c in ("doc", "fp", "cnt", "pos")), strict=True):
        made = _unpack(*(x.as_buffer() for x in row))
        n = len(made[0])
        out.append(made if keep is None else tuple(x[keep[at : at + n]] for x in made))
        at += n
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _doc_bin(doc: np.ndarray, bins: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U64)) % U64(bins)).astype(np.int32)


def _ordered(bins, keys, doc, fp, pos, src=None, diag=None) -> pa.RecordBatch:
    at = np.lexsort((pos, fp, doc, bins))
    pick = lambda x: None if x is None else x[at]
    return _rows(bins[at], pick(keys), doc[at], fp[at], pos[at], pick(src), pick(diag))


def _sources(new: np.ndarray, row: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For occurrences sorted by (edge, doc, row, position): (the source occurrence of each, occurrences in its document).

    The source is in the edge's first document. An edge that occurs there more than once is on a loop of the graph: the
    occurrences of every other row take its occurrences in turn, so that loops run along loops.
    """
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    first = start[group]
    many = np.add.reduceat((doc == doc[first]).astype(np.int64), start)[group]
    fresh = new.copy()
    fresh[1:] |= (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])
    turn = np.arange(len(new)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return first + turn % many, many


def repeated_edges(docs: DataFrame, k: int, bins: int, bits: int = 64) -> DataFrame:
    """Packed occurrences (doc_id, position) of edges that start in a smaller doc_id, with source document and offset."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # edges that have repeated: hash, document, position
        for batch in gathered(batches, 2, _BATCH):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            prints = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            h, doc, pos = windows(word_table(*text_buffers(batch.column(2))), k)
            h &= U64((1 << bits) - 1)
            at = np.minimum(np.searchsorted(known[0], h), max(len(known[0]) - 1, 0))
            old = (known[0][at] == h) & (known[1][at] < ids[doc]) if len(known[0]) else np.zeros(len(h), bool)
            if old.any():
                d, at = ids[doc[old]], at[old]
                yield _ordered(_doc_bin(d, bins), None, d, prints[doc[old]], pos[old], known[1][at], known[2][at] - pos[old])
                h, doc, pos = h[~old], doc[~old], pos[~old]
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")  # within an edge: by doc_id, then position
            hs, owner = h[order], ids[doc[order]]
            new = np.concatenate(([True], hs[1:] != hs[:-1]))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            source, many = _sources(new, doc[order], owner)
            inner = owner != owner[first]
            # One occurrence of each edge goes to its bin for every position in the batch's first document.
            out = np.zeros(len(h), bool)
            out[order[~inner]] = True
            key_bin = (h >> U64(40)) % U64(bins)
            send = np.flatnonzero(out)
            send = send[np.argsort(key_bin[send], kind="stable")]
            yield _rows(key_bin[send].astype(np.int32), h[send], ids[doc[send]], prints[doc[send]], pos[send])
            if inner.any():
                a, b = order[inner], order[source[inner]]
                d = ids[doc[a]]
                yield _ordered(_doc_bin(d, bins), None, d, prints[doc[a]], pos[a], ids[doc[b]], pos[b] - pos[a])
                new = np.unique(first[inner & (many == 1)])[: _KNOWN - len(known[0])]
                more = (hs[new], owner[new], pos[order[new]])
                merged = [np.concatenate(x) for x in zip(known, more, strict=True)]
                by = np.argsort(merged[0], kind="stable")
                known = tuple(x[by] for x in merged)

    def settle(table: pa.Table) -> pa.Table:
        done = table.filter(pa.compute.is_null(table["keys"]))
        made = [done] if done.num_rows else []
        open_ = table.filter(pa.compute.is_valid(table["keys"]))
        if open_.num_rows:
            key = unpacked(open_["keys"], "<u8")
            many = _met_again(key)
            key, (doc, fp, pos) = key[many], _occurrences(open_, many)
            order = np.lexsort((pos, fp, doc, key))
            key, doc, fp, pos = key[order], doc[order], fp[order], pos[order]
            if len(key):
                source, _ = _sources(np.concatenate(([True], key[1:] != key[:-1])), fp, doc)
                hit = np.flatnonzero(doc != doc[source])
                d, src, diag = doc[hit], doc[source[hit]], pos[source[hit]] - pos[hit]
                made.append(pa.Table.from_batches([_ordered(_doc_bin(d, bins), None, d, fp[hit], pos[hit], src, diag)]))
        return pa.concat_tables(made) if made else _FIELDS.empty_table()

    keyed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("fp"), "text")
    return keyed.mapInArrow(emit, _PACK).groupBy("bin").applyInArrow(settle, _PACK)


def walks(edges: DataFrame) -> DataFrame:
    """Segments of consecutive repeated edges with consecutive source positions: one row each, `n` edges long."""

    def join(table: pa.Table) -> pa.Table:
        doc, fp, pos = _occurrences(table)
        src, diag = unpacked(table["src"], "<i8"), unpacked(table["diag"], "<i4").astype(np.int64)
        order = np.lexsort((src, pos, fp, doc))
        doc, fp, pos, src, diag = doc[order], fp[order], pos[order], src[order], diag[order]
        again = np.concatenate(([False], (doc[1:] == doc[:-1]) & (fp[1:] == fp[:-1]) & (pos[1:] == pos[:-1])))
        doc, fp, pos, src, diag = (x[~again] for x in (doc, fp, pos, src, diag))
        goes = (doc[1:] == doc[:-1]) & (fp[1:] == fp[:-1]) & (pos[1:] == pos[:-1] + 1) & (src[1:] == src[:-1]) & (diag[1:] == diag[:-1])
        at = np.flatnonzero(np.concatenate(([True], ~goes)))
        n = np.diff(np.append(at, len(doc)))
        cols = (doc[at], fp[at], pos[at], n, src[at], pos[at] + diag[at])
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in _SEGMENT.split(", ")])

    return edges.groupBy("bin").applyInArrow(join, _SEGMENT)


def compact_paths(segments: DataFrame) -> DataFrame:
    """Adds `path`: segments joined over non-branching nodes have the same path id (that of the path's first segment).

    A node lies between two segments that touch in some document. It does not branch when one segment enters it and one
    leaves it. Links over such nodes form chains, whose heads pointer doubling finds in log2(length) rounds.
    """
    s = segments.withColumn("seg", F.xxhash64("src", "src_start", "n"))
    a = s.select("doc_id", "fp", (F.col("start") + F.col("n")).alias("at"), F.col("seg").alias("tail"))
    b = s.select("doc_id", "fp", F.col("start").alias("at"), F.col("seg").alias("head"))
    nodes = a.join(b, ["doc_id", "fp", "at"]).where("tail <> head").select("tail", "head").distinct()
    ins = nodes.groupBy("head").agg(F.count("*").alias("ins"))
    outs = nodes.groupBy("tail").agg(F.count("*").alias("outs"))
    simple = nodes.join(ins, "head").join(outs, "tail").where("ins = 1 and outs = 1")
    link = materialize(simple.select(F.col("head").alias("seg"), F.col("tail").alias("up")), "links")
    for _ in range(40):  # chains of up to 2**40 segments; a cycle keeps the pointer it has then
        ahead = link.select(F.col("seg").alias("up"), F.col("up").alias("over"))
        step = link.join(ahead, "up", "left")
        if step.where("over is not null and over <> seg").isEmpty():
            break
        before, link = link, materialize(step.select("seg", F.when(F.col("over") == F.col("seg"), F.col("up")).otherwise(F.coalesce("over", "up")).alias("up")), "links")
        discard(before)
    return s.join(link, "seg", "left").withColumn("path", F.coalesce("up", "seg")).drop("up", "seg")


def path_spans(segments: DataFrame) -> DataFrame:
    """doc_id, fp, start, n (edges), path, route: segments of one path that follow each other in a document as one span.

    `route` lists the segments: n, src, src_start.
    """
    own = Window.partitionBy("doc_id", "fp").orderBy("start")  # as many rows as a document has segments
    goes_on = (F.lag("path").over(own) == F.col("path")) & (F.lag(F.col("start") + F.col("n")).over(own) == F.col("start"))
    numbered = segments.withColumn("run", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("run").over(own))
    part = F.struct("start", "n", "src", "src_start")
    made = numbered.groupBy("doc_id", "fp", "run").agg(F.first("path").alias("path"), F.min("start").alias("start"), F.sum("n").alias("n"), F.sort_array(F.collect_list(part)).alias("parts"))
    route = F.transform("parts", lambda p: F.struct(p["n"].alias("n"), p["src"].alias("src"), p["src_start"].alias("src_start")))
    return made.select("doc_id", "fp", "start", "n", "path", route.alias("route"))


def word_digests(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, fp, own, start, n_words, digest: SHA-256 of word ranges of `docs` (doc_id, text).

    `asked` (doc_id, want, start, n_words): `want` is the hash of the text, or null for every text of that doc_id. Only
    texts that hold a range are read again; each range is hashed once.
    """
    ranges = asked.distinct().groupBy("doc_id", "want").agg(F.collect_list(F.struct("start", "n_words")).alias("ranges"))
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("fp"), "text")
    both = texts.join(ranges, "doc_id").where("want is null or want = fp").withColumn("own", F.col("want").isNotNull())

    def digest(batches):
        for batch in batches:
            rows = [(r["doc_id"], r["fp"], r["own"], s["start"], s["n_words"], hashlib.sha256(b" ".join(w[s["start"] : s["start"] + s["n_words"]])).digest())
                    for r in batch.to_pylist() for w in [(r["text"] or "").encode().split()] for s in r["ranges"]]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "fp", "own", "start", "n_words", "digest"])

    return both.select("doc_id", "fp", "own", "text", "ranges").mapInArrow(digest, "doc_id long, fp long, own boolean, start long, n_words long, digest binary")


def verified(docs: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """`spans` (doc_id, fp, start, n, path, route) with n_words and `good`: whether their words are those of the sources."""
    spans = spans.withColumn("n_words", F.col("n") + F.lit(k - 1))
    head = spans.groupBy("route").agg(F.min(F.struct("doc_id", "fp", "start", "n_words")).alias("head"))
    at = F.aggregate(F.slice("route", 1, F.col("i")), F.lit(0).cast("long"), lambda x, p: x + p["n"])
    parts = head.select("head", F.size("route").alias("m"), "route", F.posexplode("route").alias("i", "p"))
    parts = parts.select("head", "m", (F.col("head.start") + at).alias("start"), (F.col("p.n") + k - 1).alias("n_words"), "p.src", "p.src_start")
    parts = materialize(parts, "parts")
    own = spans.select("doc_id", F.col("fp").alias("want"), "start", "n_words")
    first = parts.select("head.doc_id", F.col("head.fp").alias("want"), "start", "n_words")
    src = parts.select(F.col("src").alias("doc_id"), F.lit(None).cast("long").alias("want"), F.col("src_start").alias("start"), "n_words")
    made = materialize(word_digests(docs, own.unionByName(first).unionByName(src)), "digests")
    mine = made.where("own").select("doc_id", "fp", "start", "n_words", "digest").distinct()
    theirs = made.where("not own").select(F.col("doc_id").alias("src"), F.col("start").alias("src_start"), "n_words", "digest").distinct()
    checked = parts.select("*", "head.doc_id", "head.fp").join(mine, ["doc_id", "fp", "start", "n_words"]).join(theirs, ["src", "src_start", "n_words", "digest"], "left_semi")
    sound = checked.groupBy("head", "m").agg(F.count("*").alias("met")).where("met = m").select("head")
    whole = mine.select(F.struct("doc_id", "fp", "start", "n_words").alias("head"), F.col("digest").alias("head_digest"))
    heads = head.join(sound, "head").join(whole, "head").select("route", "head_digest")
    out = spans.join(mine, ["doc_id", "fp", "start", "n_words"]).join(heads, "route", "left")
    out = materialize(out.select("doc_id", "fp", "start", "n_words", "path", "route", F.coalesce(F.col("digest") == F.col("head_digest"), F.lit(False)).alias("good")), "spans")
    discard(parts, made)
    return out


def settled_by_words(docs: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """doc_id, fp, start, n_words: single windows of `spans` (whose hashes misled) that occur in a smaller doc_id.

    Windows meet by their words. Every holder of a misleading edge but its source has a span here, or a span whose
    source has one; of sources all windows are taken.
    """
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("fp"), words.alias("w"))
    sources = spans.select(F.explode("route.src").alias("doc_id")).distinct()
    own = texts.join(spans.select("doc_id", "fp", "start", F.col("n_words")), ["doc_id", "fp"]).select("doc_id", "fp", "w", F.lit(True).alias("own"), F.explode(F.sequence("start", F.col("start") + F.col("n_words") - k)).alias("start"))
    other = texts.join(sources, "doc_id", "left_semi").where(F.size("w") >= k).select("doc_id", "fp", "w", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.size("w").cast("long") - k)).alias("start"))
    windows_ = own.unionByName(other)
    windows_ = windows_.select("doc_id", "fp", "own", "start", F.slice("w", (F.col("start") + 1).cast("int"), k).alias("window"))
    least = windows_.groupBy("window").agg(F.min("doc_id").alias("least"))
    return windows_.where("own").join(least, "window").where("least < doc_id").select("doc_id", "fp", "start", F.lit(k).cast("long").alias("n_words")).distinct()


def repeated_spans(docs: DataFrame, k: int = 13, bins: int | None = None, bits: int = 64) -> DataFrame:
    """doc_id, fp (hash of the text), start, n_words, path, route: every repeated span with its sources.

    Results do not depend on the number of hash `bits`; fewer than 64 only make more work.
    """
    bounded_batches(docs.sparkSession, 1 << 20)
    segments = materialize(walks(repeated_edges(docs, k, bins or bins_for(docs), bits)), "segments")
    spans = materialize(path_spans(compact_paths(segments)), "paths")
    discard(segments)
    checked = verified(docs, spans, k)
    discard(spans)
    bad = checked.where("not good")
    found = checked.where("good").drop("good")
    if bad.isEmpty():
        return found
    by_words = settled_by_words(docs, bad, k).withColumns({"path": F.lit(None).cast("long"), "route": F.lit(None).cast(found.schema["route"].dataType)})
    return found.unionByName(by_words)


def cut_words(text: bytes, keep: list[int]) -> bytes:
    """Only the words with these numbers, each with the white space after it, and what stands before the first word."""
    at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    ends = [*at[1:], len(text)]
    return text[: at[0] if at else None] + b"".join(text[at[i] : ends[i]] for i in keep)


def remove_repeats(docs: DataFrame, k: int = 13, bins: int | None = None, bits: int = 64, joined: bool = True) -> DataFrame:
    """`docs` with text = the kept words joined by one space, plus n_words and n_removed in place of columns of these names.

    Not `joined`: words go from the text as it stands, with the white space after them, and texts without a repeat stay
    as they are. Other columns stay, whatever their names.
    """
    spans = repeated_spans(docs, k, bins, bits)
    cover = spans.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("__cover"))
    keyed = docs.withColumn("__fp", F.xxhash64("text"))
    hit = keyed.join(cover.withColumnsRenamed({"doc_id": "__id", "fp": "__f"}), (F.col("doc_id") == F.col("__id")) & (F.col("__fp") == F.col("__f")), "left").drop("__id", "__f", "__fp")

    def cut(batches):
        for batch in batches:
            texts, counts, gone = [], [], []
            at_text, at__cover = batch.schema.get_field_index("text"), batch.schema.get_field_index("__cover")
            covers = batch.column(at__cover)
            for i, text in enumerate(batch.column(at_text)):
                words = (text.as_py() or "").encode().split()
                n, keep, to = len(words), [], 0
                if covers[i].is_valid:
                    for span in covers[i].as_py():
                        keep += range(to, max(to, span["start"]))
                        to = max(to, span["start"] + span["n_words"])
                    keep += range(to, n)
                    raw = None if joined else cut_words(text.as_py().encode(), keep)
                    words = [words[j] for j in keep]
                else:
                    raw = None if joined or not text.is_valid else text.as_py().encode()
                texts.append(b" ".join(words) if joined else raw)
                counts.append(n)
                gone.append(n - len(words))
            batch = batch.set_column(at_text, "text", pa.array(texts, pa.binary()).cast(pa.string()))
            batch = batch.set_column(at__cover, "n_words", pa.array(counts, pa.int64()))
            yield batch.append_column("n_removed", pa.array(gone, pa.int64()))

    names = [c for c in hit.columns if c not in ("n_words", "n_removed")]
    hit = hit.select(*names)
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" if f.name != "__cover" else "n_words long" for f in hit.schema] + ["n_removed long"])
    return hit.mapInArrow(cut, fields)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i+12] AS win FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
s AS (SELECT win, min(doc_id) AS first_doc FROM g GROUP BY win),
r AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN s ON g.win = s.win WHERE s.first_doc < g.doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_contains(coalesce(c.gone, []::BIGINT[]), i) THEN NULL ELSE ws[i] END), lambda x: x IS NOT NULL) AS kept
      FROM w LEFT JOIN (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id) c ON w.doc_id = c.doc_id)
SELECT doc_id, n AS n_words, n - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
