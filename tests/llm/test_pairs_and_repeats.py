"""N-gram Jaccard join and substring dedup against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import components, jaccard, kernels, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(texts, n, percent):
    sets, parent = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, texts, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, n, percent).collect()}
    assert got == groups(texts, n, percent)


def test_jaccard_keeps_one(docs, texts):
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in groups(texts, 5, 80).items() if i == c)


def test_copies_of_a_class_are_sent_and_kept_once(spark):
    """Copies in many tasks and batches add no rows to lists: a class has a shingle once, or once in either of its two bins."""
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near = [text("b"), text("b", 57), text("b", 54)]
    rows = [(i, (text("a"), *near)[i % 4]) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id")
    tokens = jaccard.shared_tokens(docs, np.zeros(1 << jaccard.SKETCH_BITS, np.uint16), 5, 80, 3)
    held = Counter((r["token"], r["sig"]) for r in tokens.collect())
    assert {sig for _, sig in held} == {jaccard.class_of(next(s for _, s in kernels.shingle_sets(kernels.word_table(*kernels.text_buffers(pa.array([t])), lower=True), 1, 5))) for t in near}
    assert max(held.values()) <= 2
    reps = tokens.groupBy("sig").agg(F.first("n").alias("n"), F.min("token").alias("doc_id"), F.array(F.lit(0)).alias("bits"))
    lists = tokens.drop("n").withColumnRenamed("token", "key").withColumn("root", F.col("sig"))
    assert all(len(set(r["key"])) == len(r["key"]) for r in jaccard.prefixes(lists, reps).collect())
    assert {r["component_id"] for r in jaccard.jaccard_groups(docs).collect()} == {0, 1}


@pytest.mark.parametrize("ways", ["plain", "lists only"])
def test_jaccard_of_long_texts(spark, monkeypatch, ways):
    """Long texts with one rare passage in common: pairs that reach the texts are those that link, and a few more."""
    rng, seen = np.random.default_rng(9), []
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    passage = text(30)
    texts = {i: f"{text(int(rng.integers(900, 5000)))} {passage} {text(600)}" for i in range(120)}
    for i in range(0, 40, 4):  # near copies, some of them over the bounds between sizes of bitmaps
        w = texts[i].split(" ")
        texts[200 + i] = " ".join(w[: len(w) - len(w) // 20])
        texts[300 + i] = " ".join([*w, *text(len(w) // 12).split(" ")])
    monkeypatch.setattr(jaccard, "linked", lambda docs, pairs, *a, f=jaccard.linked: (seen.append(pairs.count()), f(docs, pairs, *a))[1])
    if ways == "lists only":  # no hubs, so lists of rare shingles give all their pairs
        monkeypatch.setattr(jaccard, "hub_pairs", lambda members, first: members.limit(0).select(F.col("sig").alias("a"), F.col("sig").alias("b")))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, 4, 85).collect()}
    assert got == groups(texts, 4, 85)
    assert sum(seen) <= 60


def test_bitmaps_of_all_sizes():
    rng = np.random.default_rng(10)
    sizes = np.array([1, 500, 1024, 1025, 1250, 2048, 2049, 2600, 20_000, 24_000])
    base = rng.integers(0, 1 << 63, 30_000).astype(np.uint64)
    sets = [base[:n] for n in sizes]
    words = jaccard.bitmap_words(sizes)
    assert words.tolist() == [8, 8, 8, 16, 16, 16, 32, 32, 256, 256]
    bits = jaccard._bitmaps(np.concatenate(sets), sizes)
    assert len(bits) == words.sum()
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(10) for j in range(i, 10) if words[j] <= 2 * words[i]], strict=True))
    apart = jaccard.bitmaps_apart(bits, words, a, b)
    assert (apart <= sizes[b] - sizes[a]).all() and (apart[a == b] == 0).all()
    other = rng.integers(0, 1 << 63, 24_000).astype(np.uint64)
    bits = jaccard._bitmaps(np.concatenate([base[:24_000], other]), np.array([24_000] * 2))
    assert jaccard.bitmaps_apart(bits, np.array([256] * 2), np.array([0]), np.array([1]))[0] > 48_000 * 0.082


def test_jaccard_edge_cases(spark, nothing):
    assert jaccard.jaccard_groups(nothing).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, None), (5, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.jaccard_groups(rows).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (5, 5), (5, 5)]


@pytest.fixture(scope="module")
def classes(spark):
    """Prefix rows of alike and unlike sets of 6 to 60 numbers, and the pairs of them with a similarity of 0.8 or more."""
    rng = np.random.default_rng(8)
    sets, base = [], rng.integers(1, 1 << 62, 60).astype(np.uint64)
    for i in range(160):
        s = base[: rng.integers(6, 61)] if i % 2 else rng.integers(1, 1 << 62, rng.integers(6, 61)).astype(np.uint64)
        s = np.concatenate((s[rng.random(len(s)) > 0.06], rng.integers(1, 1 << 62, rng.integers(0, 3)).astype(np.uint64)))
        sets.append(np.unique(s))
    prefix = {i: s[: len(s) - -(-80 * len(s) // 100) + 2] for i, s in enumerate(sets)}
    often = Counter(int(x) for p in prefix.values() for x in p)
    rows = []
    for i, p in prefix.items():
        shared = [(int(np.array(x).view(np.int64)), r, often[int(x)]) for r, x in enumerate(p) if often[int(x)] > 1]
        bits = [int(x) for x in jaccard._bitmaps(sets[i], np.array([len(sets[i])]))]
        rows.append((i, len(sets[i]), i, 1000 + i, bits, [k for k, _, _ in shared], [r for _, r, _ in shared], [c for _, _, c in shared]))
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)}
    return spark.createDataFrame(rows, "sig long, n int, root long, doc_id long, bits array<long>, key array<long>, rank array<int>, len array<long>").repartition(3), linked


@pytest.mark.parametrize("limit", [0, 25, 1000])
@pytest.mark.parametrize("hot", [5, 20_000])
def test_lists_lose_no_link(classes, limit, hot):
    """Subsets, scanned lists and both, in whole lists and in lists cut into parts."""
    rows, linked = classes
    made = [(r["a"], r["b"]) for r in jaccard.list_pairs(rows, limit, 80, 7, hot).collect()]
    assert len(linked) > 100 and linked <= set(made) and len(made) == len(set(made)) < 4 * len(linked)


def test_keys_are_made_in_parts():
    """Pairs of many sets' shingles are sent on as they are made, none twice and none left out."""
    sets, each = 2000, 50
    rng = np.random.default_rng(3)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(sets + 1) * each, pa.int32()), x)
    ids = pa.array(np.arange(sets))
    bits = pa.ListArray.from_arrays(pa.array(np.arange(sets + 1) * 8, pa.int32()), pa.array(np.zeros(8 * sets, np.int64)))
    cols = [ids, pa.array(np.full(sets, 200, np.int32)), ids, ids, bits, lists(pa.array(rng.integers(0, 1 << 62, sets * each))), lists(pa.array(np.tile(np.arange(each, dtype=np.int32), sets))), lists(pa.array(np.full(sets * each, 2)))]
    batch = pa.RecordBatch.from_arrays(cols, ["sig", "n", "root", "doc_id", "bits", "key", "rank", "len"])
    tracemalloc.start()
    seen = []
    for part in jaccard.key_rows(batch, 1000, 80, 16, jaccard.HOT):
        at = np.concatenate([kernels.unpacked(part.column(3).slice(i, 1), "<i8")[kernels.unpacked(part.column(2).slice(i, 1), "<i4")] for i in range(part.num_rows)])
        seen.append(np.bincount(at, minlength=sets))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (sum(seen) == each * (each - 1) // 2).all() and len(seen) > 5
    assert most < 60 << 20


def test_boundary(classes):
    """The size of the least total cost, and what lies on either side."""
    rows, _ = classes
    held = [(r["n"], len(r["key"]), sum(r["len"])) for r in rows.collect()]
    made = jaccard.boundary(rows, 80)
    cost = lambda top: sum(k * (k - 1) / 2 if n <= top else scan for n, k, scan in held)
    assert made.scan_all == cost(0) and made.cost == cost(made.size) < min(cost(0), cost(1000) + 1)
    assert made.small == sum(n <= made.size for n, _, _ in held) > 0 and made.small + made.large == len(held)


def test_clashing_sets(spark):
    rows = spark.createDataFrame([(1, 7, 70), (2, 7, 70), (3, 8, 80), (4, 8, 81), (5, None, None)], "doc_id long, sig long, other long")
    assert jaccard.find_clashes(rows) == frozenset({8})
    s = np.arange(5, dtype=np.uint64)
    assert jaccard.class_of(s) == jaccard.set_hash(s) != jaccard.class_of(s, frozenset({jaccard.set_hash(s)})) == jaccard.set_hash(s, 1)


def test_sql_equals_brute_force():
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    own = dict(c.execute("SELECT doc_id, text FROM documents").fetchall())
    assert {i: (n, m) for i, n, m in c.execute(jaccard.ORACLE).fetchall()} == groups(own, 4, 85)


def removed(texts, k):
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = {}
    for i, t in texts.items():
        w = words(t)
        gone = {j + d for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for d in range(k)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize(("k", "bins"), [(13, None), (13, 3), (3, 7)])
def test_substrings(docs, texts, k, bins):
    made = repeats.remove_repeats(docs.drop("n_words"), k, bins)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in made.collect()}
    assert got == removed(texts, k)
    assert set(docs.drop("n_words").columns) < set(made.columns)


def test_substrings_edge_cases(spark, docs, nothing):
    assert repeats.remove_repeats(nothing).count() == 0
    assert repeats.remove_repeats(docs).count() == docs.count()  # a clashing n_words column is replaced
    long = " ".join(f"v{i}" for i in range(30))
    rows = spark.createDataFrame([(2, long), (2, long), (1, long), (None, long), (1, long + " tail"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.remove_repeats(rows).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30), (2, 30), (3, 0)]


def test_paths_and_sources(docs, texts):
    spans = repeats.repeated_spans(docs, 13).collect()
    assert spans
    for s in spans:
        mine = words(texts[s["doc_id"]])[s["start"] : s["start"] + s["n_words"]]
        at = 0
        for p in s["route"]:
            assert mine[at : at + p["n"] + 12] == words(texts[p["src"]])[p["src_start"] : p["src_start"] + p["n"] + 12] and p["src"] < s["doc_id"]
            at += p["n"]
        assert at + 12 == s["n_words"]


def test_path_spans(spark):
    rows = [(5, 0, 0, 4, 1, 0, 9), (5, 0, 4, 3, 2, 50, 9), (5, 0, 7, 2, 2, 90, 8), (5, 0, 20, 1, 1, 4, 9), (6, 0, 0, 3, 2, 50, 9)]
    made = repeats.path_spans(spark.createDataFrame(rows, "doc_id long, fp long, start long, n long, src long, src_start long, path long"))
    got = sorted((r["doc_id"], r["start"], r["n"], r["path"], [tuple(p) for p in r["route"]]) for r in made.collect())
    assert got == [(5, 0, 7, 9, [(4, 1, 0), (3, 2, 50)]), (5, 7, 2, 8, [(2, 2, 90)]), (5, 20, 1, 9, [(1, 1, 4)]), (6, 0, 3, 9, [(3, 2, 50)])]


def test_words_cut_from_the_text(docs, texts):
    """Without joining, white space of what stays is untouched."""
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, 13, joined=False).collect()}
    for i, (_, gone, kept) in removed(texts, 13).items():
        assert got[i]["n_removed"] == gone and words(got[i]["text"]) == words(kept)
        assert gone or got[i]["text"] == texts[i]
    assert repeats.cut_words(b" a  b\nc d\t", [0, 2]) == b" a  c "


def test_bins_are_settled_in_bounded_memory(monkeypatch):
    """Small Arrow batches are gathered, so bins get as many rows as from large ones; a bin unpacks only what repeats."""
    steps = {}

    class Docs:
        where = select = groupBy = alias = lambda self, *a: self
        mapInArrow = lambda self, f, fields: steps.setdefault("emit", f) and self
        applyInArrow = lambda self, f, fields: steps.setdefault("settle", f) and self

    monkeypatch.setattr(repeats.F, "xxhash64", lambda *a: Docs())
    repeats.repeated_edges(Docs(), 13, 1)
    rng = np.random.default_rng(3)
    word = np.array([f"w{i}" for i in range(40_000)])
    texts = [" ".join(word[rng.integers(0, len(word), 2000)]) for _ in range(330)] + ["", None]
    texts.append(texts[7])
    batch = pa.record_batch({"doc_id": np.arange(len(texts)), "fp": np.arange(len(texts)), "text": texts})
    made = list(steps["emit"](batch.slice(i, 5) for i in range(0, batch.num_rows, 5)))
    assert 3_500_000 < batch.nbytes < 5_000_000 and sum(x.num_rows for x in made) <= 4
    table = pa.Table.from_batches(made).combine_chunks()
    tracemalloc.start()
    try:
        out = steps["settle"](table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    doc, _, pos = repeats._occurrences(out)
    assert set(doc.tolist()) == {len(texts) - 1} and sorted(pos.tolist()) == list(range(1988))
    assert peak < 30_000_000


def test_windows_of_one_hash(docs, texts):
    """With hashes of 6 bits nearly all windows clash; what is removed stays right, by the words themselves."""
    few = {i: t for i, t in texts.items() if i < 40}
    rows = docs.where("doc_id < 40")
    assert repeats.repeated_spans(rows, 5, 3, bits=6).where("route is null").count() > 0
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in repeats.remove_repeats(rows, 5, 3, bits=6).collect()}
    assert got == removed(few, 5)


def test_path_compaction(spark):
    rows = [(d, 0, s, n, 1, a) for d in (5, 6) for s, n, a in ((0, 4, 0), (4, 3, 50), (7, 2, 90))] + [(7, 0, 0, 3, 1, 50), (7, 0, 3, 2, 1, 200)]
    paths = repeats.compact_paths(spark.createDataFrame(rows, "doc_id long, fp long, start long, n long, src long, src_start long"))
    by = {(r["doc_id"], r["start"]): r["path"] for r in paths.collect()}
    assert by[5, 0] == by[5, 4] == by[6, 4] and by[5, 7] != by[5, 4] and by[7, 3] != by[7, 0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7), (200, 201), (201, 200)]
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98, 200: 200, 201: 200}


def test_gathered_batches():
    rows = [None, "", "é" * 30, "a" * 500, *["b" * 40] * 9, "c" * 90, None]
    batch = pa.record_batch({"doc_id": np.arange(len(rows)), "text": rows})
    for step in (1, 3, len(rows)):
        made = list(kernels.gathered((batch.slice(i, step) for i in range(0, len(rows), step)), 1, 100))
        assert [x for b in made for x in b.column(1).to_pylist()] == rows
        sizes = [sum(len((x or "").encode()) for x in b.column(1).to_pylist()) for b in made]
        assert all(x <= 100 or b.num_rows == 1 or step > 1 for x, b in zip(sizes, made, strict=True)) and len(made) < len(rows)


def test_word_table(texts):
    import pyarrow as pa

    column = pa.array(list(texts.values()), pa.string())
    for lower in (False, True):
        t = kernels.word_table(*kernels.text_buffers(column), lower)
        want = [(i, w.encode()) for i, x in enumerate(texts.values()) for w in words(x)]
        raw, _ = kernels.text_buffers(column)
        assert [(d, raw[a:b].tobytes()) for d, a, b in zip(t.doc, t.start, t.end, strict=True)] == want
    hashes = Counter(t.hash.tolist())
    assert len(hashes) == len({re.sub(b"[A-Z]", lambda m: m[0].lower(), w) for _, w in want})


def test_queries_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    own = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op1_ngram_jaccard_join(spark, sf).collect()}
    assert got == groups(own, 4, 85)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.op5_substring_dedup(spark, sf).collect()}
    assert got == {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for i, (a, b, c) in removed(own, 13).items()}
