"""N-gram Jaccard join (1): size-aware heavy-light join of shingle sets, and the groups its links make.

Two texts link when 100 * |intersection| >= percent * |union| of their distinct n-word shingles (words lower-cased A-Z).
Equal sets are one *class* from the start, so copies cost one row each.

1. `class_table`: per document its set size, class and a parity bitmap, of 512 bits up to 1024
   shingles and about a bit for every two shingles beyond; the same pass counts shingles in a
   sketch of fixed size. The sketch only orders shingles from rare to frequent; any order gives right results.
2. `shared_tokens`: the first shingles of each set in that order (prefix filter: linked sets share two shingles within
   their first n - ceil(t * n) + 2) go in packed rows to bins, which keep those that two or more classes hold.
3. Groups of near copies are contracted first: every class is compared with one hub of each of its shingles' lists, the
   class for which the shingle is rarest (a text that the others were changed from has no rare shingles of its own, so
   it tends to be the hub of them all); then with another hub of each list that is left. Lists within one component
   are done: two classes that still have to meet are in different components, so all shingles they share are in the
   lists that are left.
4. `join_keys`: for small sets every 2-subset of the shingles that are left is a key, for large sets every shingle is
   one (its inverted list is scanned). The boundary is the size at which the summed cost is least: number of subsets
   against lengths of the lists. Sets up to boundary / t carry subsets too, so pairs over the boundary meet.
5. All classes of a key's list that are in different components are compared, so no link is lost, while a dense group of
   any size costs about one comparison per member and hub round. Keys stay packed in binary rows; a list that may be
   longer than `HOT` is cut into parts by class, and every two parts meet in a bin of their own.
6. A candidate is dropped by set size or when the bitmaps differ in more bits than the symmetric difference may have
   (never a linked pair), else both texts are read and the intersection is counted in full.

Classes are known by a 64-bit hash of the set; a second one tells apart unequal sets of one hash, whose documents then
use the second (`clashes`).

Defined cases: null or empty texts have no shingles and link with nothing; rows without doc_id link with nothing and
have no component; a text with fewer words than n is one shingle; repeated rows and equal texts link; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, gathered, mix, packed, shingle_sets, sliced, text_buffers, unpacked, word_table
from .shared import bins_for, bounded_batches, discard, materialize, one_per_id

SKETCH_BITS = 20  # cells of the frequency sketch: a fixed 4 MB a task and 2 MB to broadcast, whatever the input
_BLOCK, _BATCH = 1 << 16, 2 << 20
_CELLS = 1 << 19  # numbers of bitmaps that are compared at once
_KEYS = 1 << 16  # keys that are made at once
HOT = 20_000  # members of a list that are compared in one place; longer lists are cut into parts
KEYS_PER_BIN, SHORT, SIDE = 200_000, 8, 256
_KNOWN = 1 << 16  # classes that a task remembers as sent
_KEEP = pa.schema([("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("rank", pa.int32())])
_KEEP_SQL = "token long, sig long, n int, rank int"
_BIN = pa.schema([("bin", pa.int32()), ("known", pa.bool_()), *((c, pa.binary()) for c in ("token", "sig", "n", "rank"))])
_BIN_SQL = "bin int, known boolean, token binary, sig binary, n binary, rank binary"
_SEEDS = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


def set_hashes(all_shingles: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of sets laid end to end, none of them empty."""
    return mix(np.add.reduceat(mix(all_shingles ^ _SEEDS[seed]), start) + size.astype(U64)).view(np.int64)


def set_hash(s: np.ndarray, seed: int = 0) -> int:
    return int(set_hashes(s, np.zeros(1, np.int64), np.array([len(s)]), seed)[0])


def class_of(s: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    made = set_hash(s)
    return set_hash(s, 1) if made in clashes else made


def bitmap_words(size: np.ndarray) -> np.ndarray:
    """Numbers of 64 cells in a set's bitmap: 8 for up to 1024 shingles, and twice as many for each doubling beyond."""
    return 8 << np.ceil(np.log2(np.maximum(size, 1024) / 1024)).astype(np.int64)


def _bitmaps(all_shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per set the parities of its shingles in cells, as numbers, laid end to end.

    A cell is the low bits of a hash, so the halves of a bitmap, one over the other, are the bitmap of half as many cells.
    """
    cells = 64 * bitmap_words(size)
    begin = np.cumsum(cells) - cells
    cell = (all_shingles >> U64(7)).astype(np.int64) & np.repeat(cells - 1, size)
    odd = np.bincount(np.repeat(begin, size) + cell, minlength=int(cells.sum())) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bitmaps_apart(bits: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells in which the bitmaps of sets a and b differ, at the size of the smaller one (at most half of the other)."""
    begin, out = np.cumsum(words) - words, np.zeros(len(a), np.int64)
    least = np.minimum(words[a], words[b])
    for m in np.unique(least).tolist():
        rows = np.flatnonzero(least == m)
        for at in range(0, len(rows), step := max(1, _CELLS // m)):
            part = rows[at : at + step]
            x, y = (_folded(bits, begin[i[part]], words[i[part]] > m, m) for i in (a, b))
            out[part] = np.bitwise_count((x ^ y).view(U64)).sum(1)
    return out


def _folded(bits: np.ndarray, begin: np.ndarray, twice: np.ndarray, m: int) -> np.ndarray:
    place = begin[:, None] + np.arange(m)
    out = bits[place]
    out[twice] ^= bits[place[twice] + m]
    return out


def class_table(docs: DataFrame, ngram: int) -> DataFrame:
    """doc_id, n, sig, other (second hash), bits of every document, and rows of the sketch (block, counts)."""
    kinds = {"doc_id": pa.int64(), "n": pa.int32(), "sig": pa.int64(), "other": pa.int64(), "bits": pa.list_(pa.int64()), "block": pa.int32(), "counts": pa.binary()}
    rows = lambda size, **cols: pa.RecordBatch.from_arrays([(cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c], t)) if c in cols else pa.nulls(size, t) for c, t in kinds.items()], list(kinds))

    def run(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for whole in batches:
            for batch in sliced(whole, 1):
                made = [s for _, s in shingle_sets(word_table(*text_buffers(batch.column(1)), lower=True), batch.num_rows, ngram)]
                n = np.array([len(s) for s in made])
                full = n > 0
                if not full.any():
                    yield rows(batch.num_rows, doc_id=batch.column(0), n=n)
                    continue
                flat, size = np.concatenate(made), n[full]
                np.add.at(cells, (flat >> U64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                index = np.where(full, np.cumsum(full) - 1, 0)
                spread = lambda x: pa.array(x[index], mask=~full)
                hashes = (spread(set_hashes(flat, np.cumsum(size) - size, size, seed)) for seed in (0, 1))
                held = pa.array(np.append(0, np.cumsum(np.where(full, bitmap_words(n), 0))), pa.int32(), mask=np.append(~full, False))
                bits = pa.ListArray.from_arrays(held, pa.array(_bitmaps(flat, size)))
                yield rows(batch.num_rows, doc_id=batch.column(0), n=n, sig=next(hashes), other=next(hashes), bits=bits)
        blocks = [i for i in range(len(cells) // _BLOCK) if cells[i * _BLOCK : (i + 1) * _BLOCK].any()]
        if blocks:
            yield rows(len(blocks), block=blocks, counts=[packed(cells[i * _BLOCK : (i + 1) * _BLOCK], "<u4") for i in blocks])

    fields = "doc_id long, n int, sig long, other long, bits array<long>, block int, counts binary"
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def find_clashes(rows: DataFrame) -> frozenset[int]:
    """Hashes that unequal sets share: N * N / 2**65 are expected of N sets, so some hundred of 10**11."""
    both = rows.where("sig is not null").groupBy("sig").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    return frozenset(r["sig"] for r in both.where("lo <> hi").select("sig").collect())


def sketch_levels(table: DataFrame) -> np.ndarray:
    """The summed sketch on a log scale; its size is fixed by `SKETCH_BITS`."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.uint64)
        for x in group["counts"].to_pylist():
            total += np.frombuffer(x, "<u4")
        level = np.round(1000 * np.log2(1 + total.astype(float))).astype("<u2")
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})

    made = table.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, level binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    for block, level in made.collect():
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(level, "<u2")
    return out


def shared_tokens(docs: DataFrame, levels, ngram: int, percent: int, bins: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """token, sig, n, rank: prefix shingles (with one more than a single shared one needs) that two or more classes hold.

    However many copies a class has, it has a row for a shingle once, or twice if copies of it fell to both its bins.
    """
    table = docs.sparkSession.sparkContext.broadcast(levels)

    def emit(batches):
        level, seen = table.value, set()
        for batch in gathered(batches, 0, _BATCH):
            tokens, sigs, sizes, ranks = [], [], [], []
            if len(seen) > _KNOWN:
                seen.clear()
            for _, s in shingle_sets(word_table(*text_buffers(batch.column(0)), lower=True), batch.num_rows, ngram):
                n = len(s)
                size = n - -(-percent * n // 100) + 2
                if n * (100 - percent) < percent:  # no set of another size or content can link
                    continue
                sig = class_of(s, clashes)
                if sig in seen:
                    continue
                seen.add(sig)
                order = np.lexsort((s, level[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]))[:size]
                tokens.append(s[order])
                ranks.append(np.arange(len(order), dtype=np.int32))
                sigs.append(np.full(len(order), sig, np.int64))
                sizes.append(np.full(len(order), n, np.int32))
            if not tokens:
                continue
            token, sig, n, rank = (np.concatenate(x) for x in (tokens, sigs, sizes, ranks))
            order = np.argsort(token, kind="stable")
            ts = token[order]
            same = ts[1:] == ts[:-1]
            again = np.zeros(len(token), bool)
            again[order] = np.concatenate(([False], same))
            many = np.zeros(len(token), bool)
            many[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            home = ((token >> U64(20)) % U64(bins)).astype(np.int32)
            spread = (mix(sig.view(U64)) % U64(bins)).astype(np.int32)
            yield from _packed_rows((~again) & ~many, home, False, token, sig, n, rank)
            yield from _packed_rows((~again) & many, home, True, token, sig, n, rank)
            yield from _packed_rows(again, spread, True, token, sig, n, rank, settled=True)

    def settle(group: pa.Table) -> pa.Table:
        known = np.repeat(group["known"].to_numpy(), np.diff(text_buffers(group["sig"])[1]) // 8)
        token, sig = (unpacked(group[c], "<i8") for c in ("token", "sig"))
        n, rank = (unpacked(group[c], "<i4") for c in ("n", "rank"))
        order = np.lexsort((~known, sig, token))  # of a class's rows one that is known, if any is
        ts, ss = token[order], sig[order]
        order = order[np.concatenate(([True], (ts[1:] != ts[:-1]) | (ss[1:] != ss[:-1])))]
        ts = token[order]
        same = ts[1:] == ts[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False])) | known[order]
        at = order[keep]
        return pa.table([pa.array(x[at]) for x in (token, sig, n, rank)], schema=_KEEP)

    return docs.where("doc_id is not null").select("text").mapInArrow(emit, _BIN_SQL).groupBy("bin").applyInArrow(settle, _KEEP_SQL)


def _packed_rows(mask, bins, known, token, sig, n, rank, settled=False):
    at = np.flatnonzero(mask)
    at = at[np.argsort(bins[at], kind="stable")]
    if not len(at):
        return
    b = bins[at]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)]))
    rows = [at[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(b[cuts[:-1]], pa.int32()), pa.array([known] * len(rows), pa.bool_())]
        + [pa.array([packed(c[r], t) for r in rows], pa.binary()) for c, t in ((token.view(np.int64), "<i8"), (sig, "<i8"), (n, "<i4"), (rank, "<i4"))],
        schema=_BIN,
    )


class Boundary(NamedTuple):
    """Sets up to `size` use subsets; cost of all scanned lists, of the choice made, sets on either side, number of keys."""

    size: int
    scan_all: float
    cost: float
    small: int
    large: int
    keys: int


def prefixes(lists: DataFrame, reps: DataFrame) -> DataFrame:
    """One row per class: sig, n, root, doc_id, bits, and its shingles `t` (len of the list, key, rank), at most its prefix."""
    lens = lists.groupBy("key").agg(F.count("*").alias("len"))
    held = lists.join(lens, "key").groupBy("sig", "root").agg(F.collect_set(F.struct("len", "key", "rank")).alias("t"))  # a row may be there twice
    return held.join(reps, "sig").select("sig", "n", "root", "doc_id", "bits", "t.key", "t.rank", "t.len")


def boundary(classes: DataFrame, percent: int) -> Boundary:
    """The set size up to which subsets cost less than scanned lists: least total over all sizes (geometric classes)."""
    step = F.floor(F.log("n") / np.log(100 / percent)).alias("step")
    per_set = classes.select("n", step, F.size("key").cast("double").alias("r"), F.aggregate("len", F.lit(0).cast("double"), lambda x, y: x + y).alias("scan"))
    sums = F.sum("scan").alias("scan"), F.sum(F.expr("r * (r - 1) / 2")).alias("enum"), F.max("n").alias("top"), F.count("*").alias("sets"), F.sum("r").alias("r")
    rows = per_set.groupBy("step").agg(*sums).orderBy("step").collect()  # one row per size class: at most a few hundred
    total = at = sum(r["scan"] for r in rows)
    keys = listed = sum(r["r"] for r in rows)
    best, cost, small, below = 0, total, 0, 0
    for r in rows:
        at += r["enum"] - r["scan"]
        listed += r["enum"] - r["r"]
        below += r["sets"]
        if at < cost:
            best, cost, small, keys = r["top"], at, below, listed
    return Boundary(best, total, cost, small, below - small, int(keys))


def _keys_of(n: int, key: np.ndarray, rank: np.ndarray, lens: np.ndarray, limit: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set and how long their lists may be: 2-subsets up to `limit` / t, single shingles above `limit`."""
    made = []
    if n > limit:
        own = rank < n - -(-percent * n // 100) + 1
        made.append((mix(key[own].view(U64)), lens[own]))
    if 100 * n <= 100 * limit * 100 / percent:
        order = np.argsort(key)
        key, lens = key[order].view(U64), lens[order]
        i, j = np.triu_indices(len(key), 1)
        made.append((mix(key[i] * U64(3) ^ mix(key[j])), np.minimum(lens[i], lens[j])))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, U64), np.zeros(0, np.int64))


def _blocked(keys: np.ndarray, lens: np.ndarray, sig: int, hot: int) -> np.ndarray:
    """Keys of the blocks that a set joins: a list that may be over `hot` long is cut into parts, and every two parts meet."""
    parts = -(-lens // hot)
    if parts.max(initial=1) == 1:
        return keys
    out = [keys[parts == 1]]
    for k, s in zip(keys[parts > 1], parts[parts > 1].tolist(), strict=True):
        own = int(mix(np.array([sig], np.int64).view(U64))[0] % U64(s))
        other = np.arange(s)
        out.append(mix(k ^ mix((np.minimum(other, own) * s + np.maximum(other, own)).astype(U64) + U64(1))))
    return np.concatenate(out)


_SETS = (("sig", "<i8"), ("root", "<i8"), ("doc", "<i8"), ("n", "<i4"), ("bits", "<u8"))
_MEET = pa.schema([("bin", pa.int32()), ("key", pa.binary()), ("of", pa.binary()), *((c, pa.binary()) for c, _ in _SETS)])


def key_rows(batch: pa.RecordBatch, limit: int, percent: int, bins: int, hot: int):
    """Keys of the sets of a batch (sig, n, root, doc_id, bits, key, rank, len), a packed row for every bin.

    Keys are made and sent on set by set, about `_KEYS` at a time: a set has as many as pairs of its shingles.
    """
    cols = [batch.column(i) for i in range(batch.num_columns)]
    sig, n, root, doc = (c.to_numpy() for c in cols[:4])
    bits, words = cols[4].flatten().to_numpy(), bitmap_words(n)
    begin = np.cumsum(words) - words
    at = cols[5].offsets.to_numpy() - cols[5].offsets[0].as_py()
    key, rank, lens = (c.flatten().to_numpy() for c in cols[5:])
    held, first, count = [], 0, 0
    for i in range(len(sig)):
        held.append(_blocked(*_keys_of(int(n[i]), *(x[at[i] : at[i + 1]] for x in (key, rank, lens)), limit, percent), int(sig[i]), hot))
        count += len(held[-1])
        if count < _KEYS and i < len(sig) - 1:
            continue
        keys, of = np.concatenate(held), np.repeat(np.arange(first, i + 1, dtype=np.int32), [len(h) for h in held])
        held, first, count = [], i + 1, 0
        home = (keys >> U64(20)) % U64(bins)
        order = np.argsort(home, kind="stable")
        keys, of, home = keys[order], of[order], home[order]
        cuts = np.flatnonzero(np.diff(home, prepend=U64(bins + 1), append=U64(bins + 1)))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            used, index = np.unique(of[a:b], return_inverse=True)
            place = np.repeat(begin[used] - (np.cumsum(words[used]) - words[used]), words[used]) + np.arange(words[used].sum())
            sets = (sig[used], root[used], doc[used], n[used], bits[place])
            rows.append((int(home[a]), packed(keys[a:b]), packed(index, "<i4"), *(packed(x, t) for x, (_, t) in zip(sets, _SETS, strict=True))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MEET.types, strict=True)], schema=_MEET)


def list_pairs(classes: DataFrame, limit: int, percent: int, bins: int, hot: int = HOT) -> DataFrame:
    """a, b, da, db: all pairs of classes in one key's list that are in different components and may link.

    Keys go to bins in packed rows: a Spark row holds the keys of one batch and bin with the sets that have them.
    """

    def emit(batches):
        for batch in batches:
            yield from key_rows(batch, limit, percent, bins, hot)

    def meet(group: pa.Table) -> pa.Table:
        sizes = np.diff(text_buffers(group["sig"])[1]) // 8
        sig, root, doc, n, bits = (unpacked(group[c], t) for c, t in _SETS)
        n, words = n.astype(np.int64), bitmap_words(n)
        of = unpacked(group["of"], "<i4") + np.repeat(np.cumsum(sizes) - sizes, np.diff(text_buffers(group["of"])[1]) // 4)
        key = unpacked(group["key"], "<u8")
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        found = []

        def check(a, b):
            """Keeps the pairs (indexes of sets) whose components differ and whose sizes and bitmaps allow a link."""
            ok = (root[a] != root[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            total = n[a] + n[b]
            ok = bitmaps_apart(bits, words, a, b) <= total - 2 * -(-percent * total // (100 + percent))
            a, b = a[ok], b[ok]
            if len(a):
                turn = sig[a] > sig[b]
                found.append((np.where(turn, b, a), np.where(turn, a, b)))

        start = np.flatnonzero(np.diff(key, prepend=key[:1] + U64(1)))
        size = np.diff(np.append(start, len(key)))
        apart = np.minimum.reduceat(root[of], start) != np.maximum.reduceat(root[of], start)
        for width in range(2, SHORT + 1):
            first = start[apart & (size == width)]
            for i in range(width):
                for j in range(i + 1, width):
                    check(of[first + i], of[first + j])
        for a, m in zip(start[apart & (size > SHORT)].tolist(), size[apart & (size > SHORT)].tolist(), strict=True):
            mine = of[a : a + m]
            for i in range(0, m, SIDE):
                for j in range(i, m, SIDE):
                    x, y = mine[i : i + SIDE], mine[j : j + SIDE]
                    p, q = np.triu_indices(len(x), 1) if i == j else (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
                    check(x[p], y[q])
            if len(found) > 1000:
                found[:] = [_distinct(sig, found)]
        a, b = _distinct(sig, found)
        return pa.table({"a": sig[a], "b": sig[b], "da": doc[a], "db": doc[b]})

    made = classes.mapInArrow(emit, "bin int, key binary, of binary, sig binary, root binary, doc binary, n binary, bits binary")
    return made.groupBy("bin").applyInArrow(meet, "a long, b long, da long, db long").distinct()


def _distinct(sig: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((sig[b], sig[a]))
    a, b = a[order], b[order]
    keep = np.concatenate(([True], (sig[a][1:] != sig[a][:-1]) | (sig[b][1:] != sig[b][:-1])))
    return a[keep], b[keep]


def _may_link(percent: int):
    """Condition on (na, ba) and (nb, bb): sizes and bitmaps allow a link.

    Sets that may link have bitmaps of one size, or one of them has twice the other's, which is then folded.
    """
    short = sum((F.bit_count(F.col("ba")[i].bitwiseXOR(F.col("bb")[i])) for i in range(8)), F.lit(0))
    m = F.least(F.size("ba"), F.size("bb"))
    fold = lambda b, i: F.when(F.size(b) > m, F.get(b, i).bitwiseXOR(F.get(b, i + m))).otherwise(F.get(b, i))
    long = F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0), lambda s, i: s + F.bit_count(fold("ba", i).bitwiseXOR(fold("bb", i))))
    total = F.col("na") + F.col("nb")
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    apart = F.when(F.greatest(F.size("ba"), F.size("bb")) == 8, short).otherwise(long)
    return sizes & (apart <= total - 2 * F.ceil(F.lit(percent) * total / F.lit(100.0 + percent)))


def _with_bits(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, with a document of either. Sizes and bitmaps are joined to distinct pairs only."""
    side = lambda x: reps.select(F.col("sig").alias(x), F.col("doc_id").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(percent)).select("a", "b", "da", "db")


def hub_pairs(members: DataFrame, first) -> DataFrame:
    """(a, b): every member (key, sig, root) with the hub of its list, if they are not joined yet.

    The hub is the member with the least `first` (columns).
    """
    hubs = members.groupBy("key").agg(F.min(F.struct(*first, "sig", "root")).alias("hub")).select("key", "hub.sig", "hub.root").toDF("key", "b", "hub_root")
    return members.join(hubs, "key").where("root <> hub_root").select(F.col("sig").alias("a"), "b").distinct()


def linked(docs: DataFrame, pairs: DataFrame, ngram: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """u, v: the pairs (a, b, da, db) whose sets, made again from the texts of da and db, are similar enough.

    Texts are smaller than their shingles, so texts are shuffled, and only those that some pair needs.
    """
    texts = wanted_texts(docs, pairs.select(F.col("da").alias("doc_id")).union(pairs.select("db")).distinct())
    left, right = (texts.select(F.col("doc_id").alias(f"d{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    both = pairs.join(left, "da").select("a", "b", "db", "ta").join(right, "db").select("a", "b", "ta", "tb")

    def sets(batch, at):
        found = shingle_sets(word_table(*text_buffers(batch.column(at)), lower=True), batch.num_rows, ngram)
        return (s for _, s in found)

    def run(batches):
        for whole in batches:
            for batch in sliced(whole, 2):
                u, v, hub, known = [], [], None, None
                asked = list(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True))
                for (a, b), x, i in zip(asked, sets(batch, 2), range(len(asked)), strict=True):
                    if b != hub:
                        hub, known = b, next(sets(batch.slice(i, 1), 3))
                    if class_of(known, clashes) != b:  # another row with the same doc_id
                        hub = None
                        continue
                    if class_of(x, clashes) != a:
                        continue
                    common = len(x) + len(known) - len(np.union1d(x, known))
                    if 100 * common >= percent * (len(x) + len(known) - common):
                        u.append(a)
                        v.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return both.mapInArrow(run, "u long, v long").distinct()


def _marks(wanted: DataFrame, bits: int) -> np.ndarray:
    """A bit array of `bits` cells with the hashed doc_id of every wanted row; `bits / 64` rows at most reach the driver."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = wanted.select(F.expr("cast(1 as bigint)").alias("one"), cell.alias("cell")).groupBy(F.floor(F.col("cell") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(one, cast(cell % 64 as int))")).alias("set"))
    out = np.zeros(bits // 64, np.int64)
    for word, value in rows.collect():
        out[word] = value
    return out.view(U64)


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of documents, without most of those that are surely not `wanted` (doc_id).

    A broadcast bit array (16 bits a wanted row, 4 MB at most) tells; the join that follows is exact.
    """
    bits = 1 << min(25, max(16, (16 * wanted.count()).bit_length()))
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted, bits))

    def run(batches):
        marked = marks.value
        for whole in batches:
            cell = whole.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = (marked[cell >> 6] >> (cell & 63).astype(U64) & U64(1)).astype(bool)
            yield whole.filter(pa.array(keep)).drop_columns(["cell"])

    cell = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("cell")
    return docs.where("doc_id is not null").select(cell, "doc_id", "text").mapInArrow(run, "doc_id long, text string")


def _mixed(lists: DataFrame, root: DataFrame | None) -> DataFrame:
    """Rows (key, sig, ...) of the lists that are not within one component, with their component's `root`."""
    joined = lists.join(root.withColumnRenamed("u", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    apart = joined.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return joined.join(apart, "key", "left_semi")


def jaccard_groups(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) for every row of `docs` (doc_id, text)."""
    bounded_batches(docs.sparkSession, 1 << 20)
    docs = docs.select("doc_id", "text")
    table = materialize(class_table(docs, ngram), "classes")
    rows = table.where("block is null").select("doc_id", "n", "sig", "other", "bits")
    clashes = find_clashes(rows)
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("sig").isin(*clashes), F.col("other")).otherwise(F.col("sig")) if clashes else F.col("sig"))
    rows = rows.select("doc_id", "n", own.alias("sig"), "bits")
    tokens = materialize(shared_tokens(docs, sketch_levels(table), ngram, percent, bins_for(docs), clashes), "tokens")
    member = tokens.select("sig").distinct()
    reps = rows.join(member, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    reps = materialize(reps, "representatives")

    links = None

    def compare(pairs: DataFrame) -> DataFrame:
        """Components of all links so far and of those among `pairs` (a, b, da, db)."""
        nonlocal links
        pairs = materialize(pairs, "pairs")
        found = materialize(linked(docs, pairs, ngram, percent, clashes), "links")
        discard(pairs)
        links = found if links is None else links.union(found)
        return components(links)

    lists = tokens.withColumnRenamed("token", "key")
    members = lists.withColumn("root", F.col("sig"))
    root = compare(_with_bits(hub_pairs(members, ["rank", F.xxhash64("sig")]), reps, percent))
    left = materialize(_mixed(lists, root), "lists")
    discard(tokens)
    root = compare(_with_bits(hub_pairs(left, [F.xxhash64("sig", "key")]), reps, percent))
    classes = materialize(prefixes(_mixed(left.drop("root"), root), reps), "prefixes")
    discard(left)
    limit = boundary(classes, percent)
    root = compare(list_pairs(classes, limit.size, percent, max(128, limit.keys // KEYS_PER_BIN)))
    discard(classes, reps)
    groups = rows.join(root.withColumnRenamed("u", "sig"), "sig", "left").withColumn("group", F.coalesce("root", "sig"))
    least = groups.where("sig is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return groups.join(least, "group", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs, ngram=4, percent=85)


def one_per_group(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the members of a group other than the one with the least doc_id; repeated rows of it become one."""
    groups = jaccard_groups(docs, ngram, percent)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    loose = docs.where("doc_id is null")
    return one_per_id(docs.join(first, "doc_id", "left_semi")).select(*docs.columns).unionByName(loose)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
t AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS grams FROM w),
s AS MATERIALIZED (SELECT doc_id, unnest(grams) AS g FROM t),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
n AS (SELECT doc_id, len(grams) AS n FROM t),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT reach.u, b.v FROM reach JOIN both_ b ON reach.v = b.u)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, r.component_id FROM n JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) r ON r.u = n.doc_id
"""
