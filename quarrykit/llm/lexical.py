"""Ranked lexical search (13): the k best documents of each item by integer term scores, through trees of documents.

Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that have a term, L
terms in all of them, n in one, df documents and tf occurrences of a term: w = floor(1000 * ln((2N + 2) / (2 df + 1))),
m = 75 + (25 n N) div L, and a document's score sums w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms.

1. One pass over the texts keeps, of each document, n and the counts of terms that any item asks for.
2. Each task sorts such vectors by document frequency, most frequent term first, and inserts about `SHARD` documents at a
   time in a tree: documents with one beginning share a path, paths without branches are one node, and up to `LEAF`
   documents of neighbouring subtrees are a leaf. A node knows the largest tf of each term and the least m below it.
3. As a score rises with tf and falls with m, these bound all scores below a node. For each item the tree is searched
   depth first, best child first; subtrees whose bound is under the item's k-th score so far are left out. A task carries
   these scores from tree to tree, and returns k rows of each item, which Spark ranks.

Items go to tasks in rounds of about `ROUND` terms by hash, each with a pass of its own, so what is broadcast is bounded.

Defined cases: null texts and items have no terms; texts without terms don't count in N; rows without doc_id or item_id
take no part; of rows with one item_id the least text counts; every row with a doc_id is a document, so repeated rows
rank side by side; a repeated term counts as often as the item has it; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import packed, text_buffers, unpacked
from .shared import bounded_batches, materialize
from .terms import LETTERS_DIGITS, PIECE, _stretches, batches_of, cell_sums, count_terms, term_array

ROUND = 500_000  # terms of items in a round
SHARD, ENTRIES, LEAF = 8192, 2 << 20, 16  # documents of a tree, its counts, documents of a leaf
_WAITING = 64, 1024  # documents of leaves that are scored together: of the first ones, and later


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of all items."""
    bounded_batches(items.sparkSession)
    items = items.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in batches_of(offsets):
                made = count_terms(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], LETTERS_DIGITS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(made.doc + a)), made.words.take(pa.array(made.term)), pa.array(made.tf)], ["item_id", "term", "times"])

    return items.mapInArrow(run, "item_id long, term string, times long")


def restricted_vectors(docs: DataFrame, words: pa.Array) -> DataFrame:
    """doc_id, n, terms, tf: of every document with terms their number, and the counts of those among `words` (packed)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words = shared.value
        width = max(1, len(words))
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in batches_of(offsets):
                text, bounds = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                whole = [(text, bounds)] if len(text) <= PIECE else [(part, np.array([0, len(part)])) for part in _stretches(text, LETTERS_DIGITS)]
                n, cell, tf = np.zeros(b - a, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                for part, ends in whole:
                    found, doc = term_array(part, ends, LETTERS_DIGITS)
                    n += np.bincount(doc, minlength=b - a)
                    code = pa.compute.index_in(found, value_set=words).fill_null(-1).to_numpy()
                    met = code >= 0
                    more = cell_sums(doc[met] * width + code[met])
                    cell, tf = cell_sums(np.append(cell, more[0]), np.append(tf, more[1])) if len(cell) else more
                doc, code = np.divmod(cell, width)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                rows = np.flatnonzero(n)
                terms, counts = ([packed(v[at[r] : at[r + 1]], "<i4") for r in rows] for v in (code, tf))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + a)), pa.array(n[rows]), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms binary, tf binary")


def document_counts(vectors: DataFrame, width: int) -> np.ndarray:
    """How many documents have each of the `width` terms."""

    def run(batches):
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(unpacked(batch.column(0), "<i4"), minlength=width)
        code = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(df[code])], ["term", "df"])

    out = np.zeros(width, np.int64)
    for row in vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # `width` rows at most
        out[row["term"]] = row["df"]
    return out


class Tree(NamedTuple):
    """A tree of documents. Postings of a term are those from `at[term]` to `at[term + 1]`."""

    children: list[list[int]]
    leaf: np.ndarray  # of each node: its first document and the one after its last, both 0 if it is none
    docs: np.ndarray  # ids, by leaf
    m: np.ndarray
    at: np.ndarray
    place: np.ndarray
    tf: np.ndarray
    node_at: np.ndarray
    node: np.ndarray
    most_tf: np.ndarray
    least_m: np.ndarray  # of each node


def _branches(begin: np.ndarray, size: np.ndarray, terms: np.ndarray, width: int, leaf: int) -> tuple[list[int], np.ndarray]:
    """Parents of all nodes (the root's is -1), and the leaf of each document.

    All nodes with more than `leaf` documents are split at once by the next term of their documents; where all of them
    have the same one, the node stays. Neighbouring children with few documents become one leaf.
    """
    parent, owner = [-1], np.zeros(len(size), np.int64)
    docs, depth = np.arange(len(size)), np.zeros(1, np.int64)
    if len(size) <= leaf:
        return parent, owner
    while len(docs):
        d = depth[owner[docs]]
        more = d < size[docs]
        term = np.zeros(len(docs), np.int64)
        term[more] = terms[begin[docs[more]] + d[more]] + 1
        cell = owner[docs] * (width + 1) + term
        order = np.argsort(cell, kind="stable")
        docs, cell = docs[order], cell[order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        count, node, ends = np.diff(np.append(first, len(cell))), cell[first] // (width + 1), cell[first] % (width + 1) == 0
        alone = np.concatenate(([True], node[1:] != node[:-1])) & np.concatenate((node[1:] != node[:-1], [True]))
        target, new_depth, bundle = np.empty(len(first), np.int64), [], None
        going = np.zeros(len(first), bool)
        for i, (u, c, one, end) in enumerate(zip(node.tolist(), count.tolist(), alone.tolist(), ends.tolist(), strict=True)):
            if one:  # one path: the node goes on, or ends with documents that are alike
                target[i], going[i] = u, not end
                continue
            if c <= leaf and bundle and bundle[1] == u and bundle[2] + c <= leaf:
                bundle[2] += c
                target[i] = bundle[0]
                continue
            target[i] = len(parent)
            parent.append(u)
            new_depth.append(depth[u])
            bundle = [len(parent) - 1, u, c] if c <= leaf else None
            going[i] = c > leaf and not end
        depth = np.append(depth, np.array(new_depth, np.int64))
        depth[target[going]] += 1
        owner[docs] = np.repeat(target, count)
        docs = docs[np.repeat(going, count)]
    return parent, owner


def _postings(term: np.ndarray, place: np.ndarray, tf: np.ndarray, width: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By term and place the largest tf."""
    cell = term * places + place
    order = np.argsort(cell, kind="stable")
    cell, tf = cell[order], tf[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    term, place = np.divmod(cell[first], places)
    return np.searchsorted(term, np.arange(width + 1)), place, np.maximum.reduceat(tf, first) if len(first) else tf[:0]


def grow(docs: np.ndarray, m: np.ndarray, size: np.ndarray, terms: np.ndarray, tf: np.ndarray, width: int, leaf: int = LEAF) -> Tree:
    """A tree of documents whose terms (numbered by frequency, ascending) and counts are laid end to end."""
    begin = np.cumsum(size) - size
    parent, owner = _branches(begin, size, terms, width, leaf)
    up, nodes = np.array(parent), len(parent)
    children: list[list[int]] = [[] for _ in parent]
    for i, u in enumerate(parent[1:], 1):
        children[u].append(i)
    order = np.argsort(owner, kind="stable")
    place = np.empty(len(docs), np.int64)
    place[order] = np.arange(len(docs))
    bounds = np.searchsorted(owner[order], np.arange(nodes + 1))
    row = np.repeat(np.arange(len(docs)), size)
    at, where, counts = _postings(terms, place[row], tf, width, len(docs))
    least = np.full(nodes, np.iinfo(np.int64).max)
    np.minimum.at(least, owner, m)
    level = np.zeros(nodes, np.int64)
    for i in range(1, nodes):  # parents come before their children
        level[i] = level[up[i]] + 1
    term, node, most = terms, owner[row], tf
    made = []
    for deep in range(int(level.max(initial=0)), -1, -1):
        here = level[node] == deep
        ends, own, largest = _postings(term[here], node[here], most[here], width, nodes)
        own_term = np.repeat(np.arange(width), np.diff(ends))
        made.append((own_term, own, largest))
        if deep:
            at_level = np.flatnonzero(level == deep)
            np.minimum.at(least, up[at_level], least[at_level])
            term, node, most = (np.append(v[~here], w) for v, w in ((term, own_term), (node, up[own]), (most, largest)))
    return Tree(children, np.stack((bounds[:-1], bounds[1:]), 1), docs[order], m[order], at, where, counts, *_postings(*(np.concatenate(v) for v in zip(*made, strict=True)), width, nodes), least)


def _stretch(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of some terms, and the term's place in the list for each."""
    size = at[terms + 1] - at[terms]
    owner = np.repeat(np.arange(len(terms)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + at[terms][owner], owner


def _weighed(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * (10**9 * tf // (1000 * tf + 12 * m))


def _score(tree: Tree, leaves: list[int], terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of all documents of some leaves."""
    lo, hi = tree.leaf[leaves].T
    places = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
    slot = np.full(len(tree.docs) + 1, -1)
    slot[places] = np.arange(len(places))
    entry, owner = _stretch(tree.at, terms)
    of = slot[tree.place[entry]]
    entry, owner, of = entry[of >= 0], owner[of >= 0], of[of >= 0]
    score = np.zeros(len(places), np.int64)
    np.add.at(score, of, _weighed(weight[owner], tree.tf[entry], tree.m[places][of]))
    return tree.docs[places], score


class Best(NamedTuple):
    """The best documents of an item so far."""

    docs: np.ndarray
    scores: np.ndarray

    def least(self, k: int) -> int:
        """A score under which a document need not be looked at."""
        return int(self.scores[k - 1]) if len(self.scores) >= k else 1

    def with_more(self, docs: np.ndarray, scores: np.ndarray, k: int) -> Best:
        docs, scores = np.append(self.docs, docs[scores > 0]), np.append(self.scores, scores[scores > 0])
        order = np.lexsort((docs, -scores))[:k]
        return Best(docs[order], scores[order])


def branch_and_bound(tree: Tree, terms: np.ndarray, weight: np.ndarray, best: Best, k: int) -> tuple[Best, int]:
    """The best of an item after this tree, and how many of its documents were scored."""
    entry, owner = _stretch(tree.node_at, terms)
    bound = np.zeros(len(tree.least_m), np.int64)
    node = tree.node[entry]
    np.add.at(bound, node, _weighed(weight[owner], tree.most_tf[entry], tree.least_m[node]))
    bound, least, scored = bound.tolist(), best.least(k), 0
    stack, leaves, waiting = [0], [], 0
    while stack:
        u = stack.pop()
        if bound[u] < least:
            continue
        if tree.children[u]:
            stack += sorted((c for c in tree.children[u] if bound[c] >= least), key=bound.__getitem__)
            continue
        leaves.append(u)
        waiting += int(tree.leaf[u, 1] - tree.leaf[u, 0])
        if waiting >= _WAITING[scored > 0]:
            best, scored = best.with_more(*_score(tree, leaves, terms, weight), k), scored + waiting
            least, leaves, waiting = best.least(k), [], 0
    if leaves:
        best, scored = best.with_more(*_score(tree, leaves, terms, weight), k), scored + waiting
    return best, scored


def _search(vectors: DataFrame, rank: np.ndarray, ids: list[int], asked: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each item in each task."""
    shared = vectors.sparkSession.sparkContext.broadcast((rank, ids, asked))

    def trees(batches, rank):
        held, docs, entries = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                term, tf = rank[unpacked(part.column(2), "<i4")], unpacked(part.column(3), "<i4").astype(np.int64)
                size = np.diff(text_buffers(part.column(2))[1]) // 4
                order = np.lexsort((term, np.repeat(np.arange(len(size)), size)))
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), size, term[order], tf[order]))
                docs, entries = docs + part.num_rows, entries + len(term)
                if docs >= SHARD or entries >= ENTRIES:
                    yield [np.concatenate(v) for v in zip(*held, strict=True)]
                    held, docs, entries = [], 0, 0
        if docs:
            yield [np.concatenate(v) for v in zip(*held, strict=True)]

    def run(batches):
        rank, ids, asked = shared.value
        best = [Best(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for docs, n, size, terms, tf in trees(batches, rank):
            tree = grow(docs, 75 + 25 * n * n_docs // n_terms, size, terms, tf, len(rank))
            best = [branch_and_bound(tree, *asked[i], best[i], k)[0] for i in range(len(ids))]
        owner = np.repeat(np.array(ids, np.int64), [len(b.docs) for b in best])
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(owner), *(pa.array(np.concatenate([none, *(b[c] for b in best)])) for c in (0, 1))], ["item_id", "doc_id", "score"])

    return vectors.where("octet_length(terms) > 0").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, per_round: int = ROUND) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents with the highest scores above 0 of each item; ties by doc_id."""
    spark = docs.sparkSession
    terms = materialize(item_terms(items), "item_terms")
    rounds, found = max(1, -(-terms.count() // per_round)), None
    for number in range(rounds):
        table = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == number).toArrow()  # about `per_round` rows
        coded = table["term"].combine_chunks().dictionary_encode()
        ids, item = np.unique(table["item_id"].to_numpy(), return_inverse=True)
        width = len(coded.dictionary)
        if not width:
            continue
        vectors = materialize(restricted_vectors(docs, coded.dictionary), "vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        df = document_counts(vectors, width)
        rank = np.empty(width, np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(width)
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        code, times = coded.indices.to_numpy(), table["times"].to_numpy()
        of = [np.flatnonzero(item == i) for i in range(len(ids))] if len(ids) < 1000 else np.split(np.argsort(item, kind="stable"), np.cumsum(np.bincount(item))[:-1])
        asked = [(rank[code[o]], (times * weight[code])[o]) for o in of]
        made = _search(vectors, rank, ids.tolist(), asked, n_docs, n_terms, k)
        found = made if found is None else found.union(made)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS i, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT i, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
n AS (SELECT i, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY i),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
p AS (SELECT i, term, count(*) AS tf FROM t GROUP BY i, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, nd),
b AS (SELECT item_id, translate(coalesce(min(text), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
q AS (SELECT item_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM b),
r AS (SELECT item_id, n.doc_id, i, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (i), s GROUP BY item_id, n.doc_id, i)
SELECT item_id, CAST(row_number() OVER v AS INT) AS rank, doc_id, score FROM r WHERE score > 0 WINDOW v AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20
"""
