"""Source divergence audit, exact top-k and ranked lexical search against brute force."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarrykit.llm import audit, lexical, queries, terms, topk

SF = "/root/testdata/sf0.001"
LETTERS, LETTERS_DIGITS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def cut(pattern, text):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", ["op11_source_divergence_audit", "op12_exact_top_k", "op13_ranked_lexical_search", "quality_base_counts", "media_payloads"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    made = queries.QUERIES[name](spark, SF)
    assert made.columns == names
    assert sorted(map(tuple, made.collect())) == sorted(found.fetchall())


# terms


@pytest.mark.parametrize(("kept", "pattern"), [(terms.LETTERS, LETTERS), (terms.LETTERS_DIGITS, LETTERS_DIGITS)])
def test_terms(texts, monkeypatch, kept, pattern):
    odd = ["A1b-ÉtÉ x\x00y", "", "zZ", "　a", *(t or "" for t in texts.values())]
    column = pa.array(odd)
    raw, offsets = np.frombuffer(column.buffers()[2], np.uint8), np.frombuffer(column.buffers()[1], np.int32).astype(np.int64)
    want = [Counter(cut(pattern, t)) for t in odd]

    def found(made):
        out = defaultdict(Counter)
        for d, t, n in zip(made.doc.tolist(), made.words.take(pa.array(made.term)).to_pylist(), made.tf.tolist(), strict=True):
            out[d][t] += n
        return out

    made = terms.count_terms(raw, offsets, kept)
    assert {d: c for d, c in enumerate(want) if c} == found(made) and made.length.tolist() == [sum(c.values()) for c in want]
    monkeypatch.setattr(terms, "PIECE", 50)
    for i in (odd.index(texts[80]), odd.index(texts[82])):  # long texts, in stretches; the second is one term
        part = raw[offsets[i] : offsets[i + 1]]
        made = terms.count_terms(part, np.array([0, len(part)]), kept)
        assert found(made)[0] == want[i] and made.length.tolist() == [sum(want[i].values())]
    ranges = list(terms.batches_of(offsets))
    assert [a for a, _ in ranges[1:]] == [b for _, b in ranges[:-1]] and ranges[0][0] == 0 and ranges[-1][1] == len(odd)


# 11


def audited(rows, min_docs=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, Counter(cut(LETTERS, t))) for l_, s, t in rows if l_ == lang]
        df = Counter(t for _, c in own for t in c)
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        count = defaultdict(Counter)
        for s, c in own:
            count[s].update(c)
            count[None].update(c)
        total = {s: sum(count[s][t] for t in kept) for s in count}
        p = {s: {t: 1 + 10**9 * (count[s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in count}
        f = lambda p, q: (p - q) ** 2 // q
        for s in count.keys() - {None}:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count.keys() - {None, s}]
            term = [(f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, ranks)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "0 as number", "1 as n", "'x' as term")
    return sorted(map(tuple, audit.audit_sources(docs.repartition(4), **options).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, texts, monkeypatch, small):
    """Copies within and between sources, a group without terms, nulls, one source alone, terms of one source."""
    if small:
        for name, value in {"_SEEN": 5, "_ENTRIES": 20, "_PAIRS": 7, "_BLOCK": 2}.items():
            monkeypatch.setattr(audit, name, value)
    rows = [(["en", "de", None][i % 3], f"s{i % 5}", t) for i, t in texts.items()]
    rows += [("en", f"s{i % 3}", "the same words THE same Words été") for i in range(9)] + [("xx", "alone", "a b c")] * 4 + [("en", "mute", None), ("en", None, "12 34"), ("zz", "a", ""), ("zz", "b", "once")]
    assert audit_rows(spark, rows) == audited(rows)


def test_audit_of_ranks_and_nothing(spark, nothing):
    rows = [("en", s, f"{w} {w}") for s in ("a", "b") for w in ("cc", "aa", "bb") for _ in range(2 + (s == "a"))]
    assert audit_rows(spark, rows, min_docs=1, term_ranks=1) == audited(rows, 1, 1)
    assert audit.audit_sources(nothing).count() == 0


def test_shares_are_exact(spark):
    rows = [(0, 0, 1), (5, 9, 3), (10**15 - 1, 10**15, 10**6), (123456789012, 999999999999999, 7), (0, 0, 0)]
    made = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", audit.share(*map(__import__("pyspark").sql.functions.col, "cnv")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // max(1, r["n"] + r["v"]) for r in made)


# 12


def nearest(vectors, every, k):
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for q in whole:
        if q % every == 0:
            best = sorted((-score(whole[q], v), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("kind", "scale"), [("few", 1.0), ("ties", 0.05), ("large", 3e4), ("huge", 3e6)])
def test_top_k(spark, kind, scale):
    """All widths of numbers, ties, copies of one vector, shorter vectors, several blocks."""
    rng = np.random.default_rng(3)
    vectors = {i - 7: (rng.normal(size=8) * scale).tolist() for i in range(15 if kind == "few" else 150)}
    vectors |= {200 + i: vectors[0] for i in range(40)} | {300: [], 301: vectors[1][:3]} if kind != "few" else {}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").selectExpr("*", "1.0 as score", "2 as cutoff")
    got = topk.top_k(rows.repartition(3), every=5, k=20, block=32, depth=21)
    assert sorted(map(tuple, got.collect())) == nearest(vectors, 5, 20)


def test_top_k_leaves_out(spark):
    inf = float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [inf, 1.0]), (4, None), (5, [0.5, -0.5]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == nearest({0: [1, 2], 5: [0.5, -0.5], 20: [0, 1]}, 20, 20)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_copied_queries_are_not_broadcast(spark):
    """The queries look small before they are copied to all groups, and must not go through the driver."""
    rows = spark.createDataFrame([(i, [float(i)], None) for i in range(30)], "vec_id long, embedding array<float>, cutoff long")
    candidates, queries = topk.materialize(topk.pack(rows, 8), "candidates"), topk.materialize(topk.pack(rows.where("vec_id < 9"), 2), "queries")
    met = topk._meetings(candidates, queries, 50)
    assert met.count() == candidates.count() * queries.count()
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_thresholds_are_safe_and_selective():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-40, 40, (4000, 64)), rng.integers(-40, 40, (50, 64))
    full, scores, own = q @ x.T, topk.partial_scores(q, x, 2), np.zeros((50, 4000), bool)
    assert all(s.dtype == np.float32 for s in scores) and (sum(scores).astype(int) == full).all()
    a, b = topk.listed(scores, own, 64)
    first = np.full(full.shape, -(10**9))
    first[a, b] = full[a, b]
    cutoff = -np.sort(-first, axis=1)[:, 19]
    assert (cutoff <= -np.sort(-full, axis=1)[:, 19]).all()
    a, b = topk.sufficient(scores, own, cutoff)
    chosen = np.zeros(full.shape, bool)
    chosen[a, b] = True
    assert chosen[full >= cutoff[:, None]].all() and chosen.mean() < 0.2


# 13


def lexical_ranks(docs, items, k=20):
    docs = [(i, Counter(cut(LETTERS_DIGITS, t))) for i, t in docs if i is not None]
    docs = [(i, c) for i, c in docs if c]
    big, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items.items():
        found = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * big // total
            s = sum(n * math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in Counter(cut(LETTERS_DIGITS, text)).items() if c[t])
            if s > 0:
                found.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_lexical(spark, docs, texts, monkeypatch, small):
    """Repeated terms in items, terms of no document, nulls, equal documents; small trees, rounds and stretches."""
    if small:
        for name, value in {"SHARD": 30, "LEAF": 2, "_WAITING": (2, 5)}.items():
            monkeypatch.setattr(lexical, name, value)
    items = {1: texts[8], 2: "the the THE été w1 w2 w3", 3: "nowhere", 4: None, 5: "", 6: texts[70], 7: "x" * 5000, 8: "a b"}
    rows = spark.createDataFrame([*items.items(), (None, "w1"), (1, None)], "item_id long, text string")
    got = lexical.ranked_documents(docs, rows.where("item_id is null or text is not null or item_id <> 1"), per_round=100 if small else 10**6)
    assert sorted(map(tuple, got.collect())) == lexical_ranks(texts.items(), items)


def test_lexical_edge_cases(spark, docs, nothing):
    items = spark.createDataFrame([(1, "one two"), (1, "zzz")], "item_id long, text string")
    assert lexical.ranked_documents(nothing, items).count() == 0
    assert lexical.ranked_documents(docs, items.limit(0)).count() == 0
    rows = [(1, "one"), (1, "one"), (None, "one two"), (2, "three one one"), (3, "three")]
    got = lexical.ranked_documents(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(tuple, got.collect())) == lexical_ranks(rows, {1: "one two"})


def test_trees_skip_documents():
    """Results are right, and where 20 documents hold all terms, most others are left out."""
    rng = np.random.default_rng(2)
    width, n = 300, 3000
    docs = [np.sort(rng.choice(width, rng.integers(3, 40), replace=False, p=np.arange(width, 0, -1) / (width * (width + 1) / 2))) for _ in range(n - 100)]
    docs += [docs[5]] * 100
    size, all_terms = np.array([len(d) for d in docs]), np.concatenate(docs)
    tf, m = rng.integers(1, 5, len(all_terms)), rng.integers(75, 200, n)
    tree = lexical.grow(np.arange(n), m, size, all_terms, tf, width)
    assert sorted(tree.docs.tolist()) == list(range(n)) and (tree.m == m[tree.docs]).all()
    leaves = [i for i, c in enumerate(tree.children) if not c]
    assert sum(int(b - a) for a, b in tree.leaf[leaves]) == n and all(a == b for i, (a, b) in enumerate(tree.leaf) if tree.children[i])
    start, scored = np.cumsum(size) - size, 0
    for step in range(20):
        asked = rng.choice(width, 12, replace=False) if step % 2 else docs[5]
        weight = rng.integers(1, 9000, len(asked))
        score = np.zeros(n, np.int64)
        for d in range(n):
            for t, w in zip(asked, weight, strict=True):
                at = start[d] + np.flatnonzero(docs[d] == t)
                if len(at):
                    score[d] += w * (10**9 * tf[at[0]] // (1000 * tf[at[0]] + 12 * m[d]))
        best, seen = lexical.branch_and_bound(tree, asked, weight, lexical.Best(np.zeros(0, np.int64), np.zeros(0, np.int64)), 20)
        order = np.lexsort((np.arange(n), -score))[:20]
        assert best.docs.tolist() == order[score[order] > 0].tolist() and best.scores.tolist() == score[order][score[order] > 0].tolist()
        scored += seen * (step % 2 == 0)
    assert scored < 10 * n // 3
