"""Source divergence audit (11): how far the sources of a language use other terms than its whole and than each other.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the V terms in at least
`min_docs` of its documents. With a term's count in a group of N kept terms, p = 1 + floor(10^9 * (count + 1) / (N + V)),
and two shares differ by f = floor((p - q)^2 / q). All of it is integer arithmetic.

1. Sources are numbered within their language. Identical texts of a language are collapsed by a 128-bit digest: a task
   passes each text on once, with a count per source, so a text that a third of all rows hold is one row per task.
2. Each text is cut into terms once; its counts are weighted by the number of its copies in each source. A task writes
   one row per language and term with the counts of all sources packed, and a second pass adds these up.
3. The sum over all kept terms for two sources starts from what their absent terms give, taken from histograms of
   counts, and is corrected only by terms that both hold. Such terms' pairs are added up as numbers within a task.

A term's counts of all sources of one language, 12 bytes each, are held at once; nothing larger is.

Defined cases: null text, language and source are ''; a text without terms still makes its group occur; every row of a
repeated document counts; an empty table gives no rows; other columns are not read. Counts may reach 10^15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import text_buffers
from .shared import bounded_batches, materialize
from .terms import LETTERS, batches_of, cell_sums, count_terms

SCALE, TERM_RANKS, MIN_DOCS = 10**9, 200, 3
_SEEN = 100_000  # different texts and counts that a task remembers at once
_TOGETHER = 1024  # tasks whose copies of one text meet in one place
_ENTRIES = 1 << 20  # counts of terms that a task adds up before it passes them on
_PAIRS = 1 << 20  # pairs of sources that are evaluated at once
_BLOCK = 1024  # sources that are evaluated against a source at once; up to so many, a task keeps one table of pairs
_HALF = np.dtype([("source", "<i4"), ("count", "<i8")])


def _binary(entries: np.ndarray, first: np.ndarray) -> pa.Array:
    """One value of each run of `entries` from `first` on."""
    at = (np.append(first, len(entries)) * entries.dtype.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(entries))]).cast(pa.binary())


def groups_of(docs: DataFrame) -> DataFrame:
    """lang, source, number (of the source within its language, from 0) of every group that occurs."""
    found = docs.select("lang", "source").distinct()
    return found.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, digest, part, number, n, text: per task one row with each different text of a language, and its copies per source."""

    def run(batches):
        part = TaskContext.get().partitionId() // _TOGETHER
        seen: dict[tuple, int] = {}

        def flush():
            rows = [(*k, n) for k, n in seen.items() if k[2] >= 0]
            seen.clear()
            langs, digests, numbers, counts = zip(*rows, strict=True)
            cols = [pa.array(langs), pa.array(digests, pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(numbers, pa.int32()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(rows), pa.string())], names)

        names = ["lang", "digest", "part", "number", "n", "text"]
        for batch in batches:
            langs, numbers, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            raw, offsets = text_buffers(texts)
            view, new = memoryview(raw), []
            for i, (lang, number) in enumerate(zip(langs, numbers, strict=True)):
                digest = hashlib.blake2b(view[offsets[i] : offsets[i + 1]], digest_size=16).digest()
                if (lang, digest, -1) not in seen:
                    seen[lang, digest, -1] = 0
                    new.append((i, digest))
                seen[lang, digest, number] = seen.get((lang, digest, number), 0) + 1
            if new:
                rows = pa.array([i for i, _ in new])
                cols = [batch.column(0).take(rows), pa.array([d for _, d in new], pa.binary()), pa.array([part] * len(new), pa.int32()), pa.nulls(len(new), pa.int32()), pa.nulls(len(new), pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, texts.take(rows)], names)
            if len(seen) > _SEEN:
                yield flush()
        if seen:
            yield flush()

    return docs.select("lang", "number", "text").mapInArrow(run, "lang string, digest binary, part int, number int, n long, text string")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], list[tuple[int, int, int]]]]:
    """Per batch the languages and texts of its different digests, and (text, source, copies) of all counts."""
    last, text = None, ""
    for batch in batches:
        texts, langs, copies, now = [], [], [], None
        cols = [batch.column(c).to_pylist() for c in ("lang", "digest", "number", "n")]
        for i, (lang, digest, number, n) in enumerate(zip(*cols, strict=True)):
            if (lang, digest) != last:
                last, text, now = (lang, digest), batch.column("text")[i].as_py(), None  # texts come first
            if number is not None:
                if now is None:
                    now = len(texts)
                    texts.append(text)
                    langs.append(lang)
                copies.append((now, number, n))
        yield langs, texts, copies


def term_counts(copies: DataFrame) -> DataFrame:
    """lang, term, docs, packed (source, count): one row per language and term of a task's stretch of texts."""

    def run(batches):
        held: list[pa.Table] = []

        def flush():
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            coded, langs = (table[c].combine_chunks().dictionary_encode() for c in ("term", "lang"))
            n = max(1, len(coded.dictionary))
            key = langs.indices.to_numpy().astype(np.int64) * n + coded.indices.to_numpy()
            source, docs, count = (table[c].to_numpy() for c in ("source", "docs", "count"))
            order = np.lexsort((source, key))
            key, source, docs, count = key[order], source[order], docs[order], count[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (source[1:] != source[:-1])))
            first = np.flatnonzero(new)
            entries = np.empty(len(first), _HALF)
            entries["source"], entries["count"] = source[first], np.add.reduceat(count, first)
            key, docs = key[first], np.add.reduceat(docs, first)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            lang, term = np.divmod(key[first], n)
            cols = [langs.dictionary.take(pa.array(lang)), coded.dictionary.take(pa.array(term)), pa.array(np.add.reduceat(docs, first)), _binary(entries, first)]
            return pa.RecordBatch.from_arrays(cols, ["lang", "term", "docs", "packed"])

        for langs, texts, copies in _runs(batches):
            if not copies:
                continue
            raw, offsets = text_buffers(pa.array(texts, pa.large_string()))
            owner, source, n = np.array(copies, np.int64).T
            lang_codes = pa.array(langs).dictionary_encode()
            lang_of = lang_codes.indices.to_numpy().astype(np.int64)
            for a, b in batches_of(offsets):
                made = count_terms(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], LETTERS)
                i, j = np.searchsorted(owner, (a, b))
                begin = np.searchsorted(made.doc, np.arange(b - a + 1))
                size = np.diff(begin)[owner[i:j] - a]
                entry = np.repeat(begin[owner[i:j] - a] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                pair, group = np.unique(np.stack((lang_of[owner[i:j]], source[i:j])), axis=1, return_inverse=True)
                times, width = np.repeat(n[i:j], size), max(1, len(made.words))
                cell, docs, count = cell_sums(np.repeat(group.ravel(), size) * width + made.term[entry], times, times * made.tf[entry])
                group, term = np.divmod(cell, width)
                cols = {"lang": lang_codes.dictionary.take(pa.array(pair[0][group])), "source": pair[1][group], "term": made.words.take(pa.array(term))}
                held.append(pa.table(cols | {"docs": docs, "count": count}))
                if sum(t.num_rows for t in held) > _ENTRIES:
                    yield flush()
        if sum(t.num_rows for t in held):
            yield flush()

    return copies.mapInArrow(run, "lang string, term string, docs long, packed binary")


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, number, term, count, total (of all sources), first (once for each term) of terms in enough documents."""

    def run(batches):
        carry: pa.Table | None = None

        def settle(table: pa.Table, last: bool):
            """Sums of all terms but the last one, which may go on, and that one."""
            coded, langs = (table[c].combine_chunks().dictionary_encode() for c in ("term", "lang"))
            key = langs.indices.to_numpy().astype(np.int64) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(text_buffers(table["packed"])[1]) // _HALF.itemsize
            entries = text_buffers(table["packed"])[0].view(_HALF)
            term = np.repeat(np.cumsum(np.isin(np.arange(len(key)), first)) - 1, size)
            cell, count = cell_sums(term << 32 | entries["source"], entries["count"])
            term, source, docs = cell >> 32, (cell & (1 << 32) - 1).astype(np.int32), np.add.reduceat(table["docs"].to_numpy(), first)
            until = len(first) if last else len(first) - 1
            rest = None
            if not last:
                own = term == until
                half = np.empty(own.sum(), _HALF)
                half["source"], half["count"] = source[own], count[own]
                rest = pa.table({"lang": table["lang"][-1:].combine_chunks(), "term": table["term"][-1:].combine_chunks(), "docs": docs[-1:], "packed": _binary(half, np.zeros(1, np.int64))})
            keep = (docs[term] >= min_docs) & (term < until)
            begin = np.concatenate(([True], term[1:] != term[:-1]))
            total = np.add.reduceat(count, np.flatnonzero(begin))[term]
            at = pa.array(first[term[keep]])
            cols = [table["lang"].combine_chunks().take(at), pa.array(source[keep]), table["term"].combine_chunks().take(at), pa.array(count[keep]), pa.array(total[keep]), pa.array(begin[keep])]
            return pa.RecordBatch.from_arrays(cols, ["lang", "number", "term", "count", "total", "first"]), rest

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry.cast(table.schema), table])
            if table.num_rows:
                made, carry = settle(table, False)
                yield made
        if carry is not None:
            yield settle(carry, True)[0]

    rows = counts.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return rows.mapInArrow(run, "lang string, number int, term string, count long, total long, first boolean")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (n + v)) by long division, so that no product passes 64 bits."""
    whole, rest, out = F.greatest(n + v, F.lit(1)), count + 1, F.lit(1)
    for scale in (10**6, 10**3, 1):
        rest = rest * 1000
        out = out + F.call_function("div", rest, whole) * scale
        rest = rest % whole
    return out


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def absent_terms(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, a, b, value: sums over all kept terms as if no term were in both sources.

    `groups`: lang, number, zero (share of an absent term), v; `shares`: lang, number, p of each term of a source.
    """
    counted = shares.groupBy("lang", "number", "p").agg(F.count("*").alias("n"))
    listed = counted.groupBy("lang", "number").agg(F.collect_list("p").alias("p"), F.collect_list("n").alias("n"))  # different counts of one source
    own = groups.join(listed, ["lang", "number"], "left").select("lang", F.col("number").alias("a"), F.col("zero").alias("za"), "v", "p", "n")
    block = F.floor(F.col("number") / _BLOCK).alias("block")
    others = groups.groupBy("lang", block).agg(F.collect_list("number").alias("b"), F.collect_list("zero").alias("zb"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lang, a, za, v = (row.column(c)[0].as_py() for c in range(4))
                p, n, b, zb = (row.column(c).flatten().to_numpy() for c in range(4, 8))
                there, back = v * _far(za, zb) - n.sum() * _far(za, zb), -n.sum() * _far(zb, za)
                for k in range(0, len(p), _BLOCK):
                    part, times = p[k : k + _BLOCK, None], n[k : k + _BLOCK, None]
                    there = there + (times * _far(part, zb[None])).sum(0)
                    back = back + (times * _far(zb[None], part)).sum(0)
                other = b != a
                b, there, back = b[other], there[other], back[other]
                same = np.full(len(b), a, np.int32)
                cols = [pa.array([lang] * (2 * len(b)), pa.string()), pa.array(np.append(same, b)), pa.array(np.append(b, same)), pa.array(np.append(there, back))]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "a", "b", "value"])

    return own.join(others, "lang").select("lang", "a", "za", "v", "p", "n", "b", "zb").mapInArrow(run, "lang string, a int, b int, value long")


def common_terms(shares: DataFrame) -> DataFrame:
    """lang, a, b, value: what `absent_terms` lacks for terms that both sources have (lang, term, number, p, zero)."""

    def run(batches):
        table, lang, carry = None, None, None

        def rows(of, a, b, value):
            return pa.RecordBatch.from_arrays([pa.array([of] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(value)], ["lang", "a", "b", "value"])

        def held():
            a, b = np.nonzero(table)
            return rows(lang, a, b, table[a, b])

        def pairs(of: str, size: np.ndarray, number: np.ndarray, p: np.ndarray, zero: np.ndarray):
            """`size`: entries of each term. Every entry meets all entries of its term."""
            nonlocal table, lang
            if of != lang:
                if table is not None:
                    yield held()
                table, lang = None, of
            width = np.repeat(size, size)
            begin = np.repeat(np.cumsum(size) - size, size)
            cut = np.cumsum(width)
            i = 0
            while i < len(width):
                j = max(i + 1, int(np.searchsorted(cut, (cut[i - 1] if i else 0) + _PAIRS, "right")))
                w = width[i:j]
                x = np.repeat(np.arange(i, j), w)
                y = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[i:j], w)
                value = _far(p[x], p[y]) - _far(p[x], zero[y]) - _far(zero[x], p[y]) + _far(zero[x], zero[y])
                x, y, i = number[x], number[y], j
                if number.max() < _BLOCK:
                    table = np.zeros((_BLOCK, _BLOCK), np.int64) if table is None else table
                    np.add.at(table, (x, y), value)
                else:
                    cell, value = cell_sums(x.astype(np.int64) << 32 | y, value)
                    yield rows(of, cell >> 32, cell & (1 << 32) - 1, value)

        def whole(batch: pa.Table, until: int, size: np.ndarray):
            langs = batch["lang"].to_pylist() if batch.num_rows else []
            ends = np.cumsum(size)[:until]
            cols = [batch[c].to_numpy() for c in ("number", "p", "zero")]
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            names = np.array([langs[k] for k in starts], object)
            change = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
            for k, m in zip(change[:-1], change[1:], strict=True):
                yield from pairs(names[k], size[k:m], *(c[starts[k] : ends[m - 1]] for c in cols))

        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = (now if carry is None else pa.concat_tables([carry, now])).combine_chunks()
            if not now.num_rows:
                continue
            coded, langs = (now[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("term", "lang"))
            first = np.flatnonzero(np.concatenate(([True], (coded[1:] != coded[:-1]) | (langs[1:] != langs[:-1]))))
            size = np.diff(np.append(first, now.num_rows))
            yield from whole(now, len(first) - 1, size)
            carry = now.slice(first[-1])
        if carry is not None:
            yield from whole(carry, 1, np.array([carry.num_rows]))
        if table is not None:
            yield held()

    rows = shares.select("lang", "term", "number", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return rows.mapInArrow(run, "lang string, a int, b int, value long").where("a <> b")


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: other sources by distance, and terms over the language's share."""
    bounded_batches(docs.sparkSession)
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs = docs.select(*empty)
    groups = materialize(groups_of(docs), "groups")
    copies = collapsed(docs.join(groups, ["lang", "source"]))
    copies = copies.repartition("lang", "digest", "part").sortWithinPartitions("lang", "digest", "number")
    kept = materialize(kept_terms(term_counts(copies), min_docs), "terms")
    langs = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    sums = kept.groupBy("lang", "number").agg(F.sum("count").alias("n"))
    known = groups.join(sums, ["lang", "number"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "n_lang"])
    known = materialize(known.withColumn("zero", share(F.lit(0).cast("long"), F.col("n"), F.col("v"))), "group_sums")
    shares = kept.join(known, ["lang", "number"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))

    q = share(F.col("total"), F.col("n_lang"), F.col("v"))
    terms = shares.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    values = absent_terms(known.drop("n", "n_lang", "source"), shares).union(common_terms(shares)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda side, to: known.select("lang", F.col("number").alias(side), F.col("source").alias(to))
    pairs = values.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= term_ranks))


def op11_source_divergence_audit(spark, sf_dir: str) -> DataFrame:
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, k.total, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)::HUGEINT) // (s.n + l.v) AS p, 1 + (1000000000 * (k.total + 1)::HUGEINT) // (l.n + l.v) AS q
 FROM g JOIN k USING (lang) JOIN l USING (lang) JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM u WHERE part = 'pair' OR rank <= 200
"""
