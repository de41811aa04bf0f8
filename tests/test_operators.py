import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import chunking, conversations, evaluation, fusion, keyword, matching, models, observability, ordering, profiling, store, vector

ARTICLE = "page_id string, title string, text string"
LONG = "\n\n".join(f"Paragraph {i}. " + "word " * (20 * i) for i in range(1, 6))


def greedy(text, target, least):
    """Row-at-a-time paragraph chunker for comparison."""
    out, buffer, used, at = [], [], 0, 0
    for part in text.split("\n\n"):
        start, end = at, at + len(part)
        at = end + 2
        clean = part.strip()
        if not clean:
            continue
        if buffer and used + len(clean) > target:
            out.append(buffer)
            buffer, used = [], 0
        buffer.append((clean, start, end))
        used += len(clean)
    out += [buffer] if buffer else []
    made = [("\n\n".join(c for c, _, _ in b), b[0][1], b[-1][2]) for b in out]
    return [m for m in made if len(m[0]) >= least]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([("1", "A", LONG), ("2", "B", "tiny"), ("3", "C", ""), ("4", "D", "x" * 300), ("5", "E", "a\n\n  \n\nb" + "c" * 500 + "\n\nd")], ARTICLE)


@pytest.mark.parametrize(("name", "settings"), [("fixed_size", {"chunk_size": 300, "overlap": 50, "min_chunk_size": 50}), ("paragraph_aware", {"target_size": 400, "max_size": 600, "min_chunk_size": 50})])
def test_chunker_invariants(spark, articles, name, settings):
    rows = chunking.chunk_articles(articles, name, **settings).collect()
    texts = {r["page_id"]: r["text"] for r in articles.collect()}
    assert len({r["chunk_id"] for r in rows}) == len(rows) and all(len(r["chunk_id"]) == 16 for r in rows)
    assert all(0 <= r["start_char"] < r["end_char"] <= len(texts[r["document_id"]]) and r["text"] for r in rows)
    assert "3" not in {r["document_id"] for r in rows}
    if name == "fixed_size":
        assert all(r["text"] == texts[r["document_id"]][r["start_char"] : r["end_char"]] and len(r["text"]) <= 300 for r in rows)
        assert sum(r["document_id"] == "2" for r in rows) == 1
    else:
        for doc, text in texts.items():
            mine = sorted((r["start_char"], r["end_char"], r["text"]) for r in rows if r["document_id"] == doc)
            assert mine == [(a, b, t) for t, a, b in greedy(text, 400, 50)]
    again = chunking.chunk_articles(articles, name, **settings)
    assert chunking.diff_chunk_tables(again, again).isEmpty()


def test_paragraph_groups_equal_one_by_one():
    rng = np.random.default_rng(8)
    texts = [[], [0, 0], [5], [5000], [0, 7, 0], *(rng.choice([0, 3, 50, 400, 1200], rng.integers(0, 60)).tolist() for _ in range(50))]
    raw = [[n + int(rng.integers(0, 3)) for n in t] for t in texts]
    arrays = (pa.array([[1]] + x, pa.list_(pa.int32())).slice(1) for x in (raw, texts))  # with an offset
    for lengths, filled, made in zip(raw, texts, chunking.group_paragraphs(*arrays, 1000).to_pylist(), strict=True):
        want, at, used = [], 0, 0
        for i, (n, m) in enumerate(zip(lengths, filled, strict=True)):
            if m and want and used + m <= 1000:
                used += m
                want[-1] |= {"last": i, "end": at + n}
            elif m:
                used = m
                want.append({"first": i, "last": i, "start": at, "end": at + n})
            at += n + 2
        assert made == want


def test_chunker_errors(articles):
    with pytest.raises(ValueError, match="overlap"):
        chunking.chunk_fixed(articles, 100, 100)
    with pytest.raises(ValueError, match="no chunker"):
        chunking.chunk_articles(articles, "other")


CHUNKS = "chunk_id string, document_id string, title string, section string, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["The Roman empire fell in the west", "Photosynthesis turns light into sugar", "A volcano erupts lava and ash", "Chess is a board game", "Whales are mammals of the sea"]
    return spark.createDataFrame([(f"c{i}", f"d{i % 2}", f"T{i}", "", t) for i, t in enumerate(texts)], CHUNKS)


def test_keyword_search(spark, chunks):
    queries = spark.createDataFrame([(1, "roman EMPIRE roman"), (2, "lava"), (3, "nothing here matches zzz"), (4, "")], "query_id int, text string")
    rows = keyword.bm25_search(queries, keyword.build_keyword_index(chunks), chunks, 2).collect()
    first = {r["query_id"]: r["chunk_id"] for r in rows if r["rank"] == 1}
    assert first == {1: "c0", 2: "c2"} and all(r["score"] > 0 and r["text"] for r in rows)


def test_keyword_index_round_trip(spark, chunks, tmp_path):
    index = keyword.build_keyword_index(chunks)
    keyword.write_keyword_index(index, str(tmp_path / "index"))
    again = keyword.read_keyword_index(spark, str(tmp_path / "index"))
    assert all(sorted(map(str, a.collect())) == sorted(map(str, b.collect())) for a, b in zip(index[:3], again[:3], strict=True)) and again.counted
    queries = spark.createDataFrame([(1, "roman EMPIRE in the"), (2, "lava")], "query_id int, text string")
    assert sorted(keyword.bm25_scores(queries, index).collect()) == sorted(keyword.bm25_scores(queries, again).collect())


def bm25(texts, query, k):
    """Every chunk scored for itself."""
    cut = lambda t: [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
    docs = {i: Counter(cut(t)) for i, t in texts.items()}
    average, df = sum(sum(c.values()) for c in docs.values()) / len(docs), Counter(t for c in docs.values() for t in c)
    out = []
    for i, c in docs.items():
        norm = keyword.K1 * (1 - keyword.B + keyword.B * sum(c.values()) / average)
        s = round(sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (keyword.K1 + 1) / (c[t] + norm) for t in set(cut(query)) if c[t]), 9)
        out += [(-s, i)] if s > 0 else []
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize(("shard", "rounds"), [(4096, 4 << 20), (70, 60)])
def test_bm25_by_shards_equals_all_chunks(spark, monkeypatch, shard, rounds):
    """Ties, large frequencies, empty chunks, words of no chunk; several shards and rounds."""
    monkeypatch.setattr(keyword, "SHARD", shard)
    monkeypatch.setattr(keyword, "ROUND", rounds)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    texts = {f"c{i:03d}": " ".join(rng.choice(words, rng.integers(0, 80), p=np.arange(200, 0, -1) / 20100)) for i in range(300)}
    texts |= {"c900": "w3 " * 300, "c901": "w1 w2", "c902": "w1 w2", "c903": ""}
    rows = spark.createDataFrame([(i, "d", "T", "", t) for i, t in texts.items()], CHUNKS).repartition(3)
    asked = {i: " ".join(rng.choice([*words, "zzz"], rng.integers(0, 12))) for i in range(12)} | {90: "w1 w2", 91: "nothing"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    found = defaultdict(list)
    for r in keyword.bm25_search(queries, keyword.build_keyword_index(rows), rows, 20).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["chunk_id"], r["score"]))
        assert r["text"] == texts[r["chunk_id"]]
    for q, text in asked.items():
        want = bm25(texts, text, 20)
        assert [i for i, _ in found[q]] == [i for i, _ in want] and np.allclose([s for _, s in found[q]], [s for _, s in want])
    assert keyword.bm25_search(queries, keyword.build_keyword_index(rows.limit(0)), rows.limit(0)).count() == 0


def test_bm25_skips_blocks():
    """Where some neighbouring chunks are about the query, most blocks of its frequent words are not read."""
    rng = np.random.default_rng(5)
    filler = [f"f{i}" for i in range(500)]
    rows = [["a", "b", "c", *rng.choice(filler, 60)] if rng.random() < 0.6 else list(rng.choice(filler, 60)) for _ in range(4000)]
    rows[2000:2024] = [["a", "b", "c"] * 8 + list(rng.choice(filler, 10)) for _ in range(24)]
    made = keyword.pack_shard(pa.array(range(4000)), pa.array(rows, pa.list_(pa.string())))
    shard = keyword.Shard(made, made["tokens"][0].as_py() / 4000)
    term = pa.compute.index_in(pa.array(["a", "b", "c"]), value_set=shard.terms).to_numpy()
    blocks = int((shard.block_at[term + 1] - shard.block_at[term]).sum())
    chunk, _, read = shard.search(term, np.ones(3), 0.0, 20)
    assert set(chunk) <= set(range(2000, 2024)) and len(chunk) >= 20 and blocks > 300 and read < blocks // 10


def test_bm25_moves_no_index(spark, chunks):
    """The plan has no exchange of index rows or chunk texts: only of the best of each task."""
    queries = spark.createDataFrame([(1, "roman EMPIRE"), (2, "lava")], "query_id int, text string")
    index = keyword.build_keyword_index(chunks)
    plan = keyword.bm25_search(queries, index, chunks, 2)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if " Exchange " in line]
    assert shuffles and all("hashpartitioning(query_id" in line for line in shuffles) and "SortMergeJoin" not in plan


@pytest.mark.parametrize("block", [2, 4096])
def test_vector_search(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8))
    x[7] = x[3]
    index = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in (0, 3, 9)], "query_id long, vector array<double>")
    rows = vector.vector_search(queries, index, 5, block=block).collect()
    for q in (0, 3, 9):
        want = sorted(range(40), key=lambda i: (round(((x[i] - x[q]) ** 2).sum(), 9), i))[:5]
        assert [r["chunk_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert vector.vector_search(queries, index, 100).count() == 120
    assert vector.vector_search(queries, index.limit(0), 5).count() == 0 and vector.vector_search(queries.limit(0), index, 5).count() == 0


def clustered(rng, n, dim=12, groups=30):
    middles = rng.normal(size=(groups, dim)) * 10
    return (middles[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.3).astype(np.float32)


@pytest.mark.parametrize(("squared", "rounds"), [(True, 32 << 20), (False, 2000)])
def test_vector_cells_are_exact_and_skip(spark, monkeypatch, tmp_path, squared, rounds):
    """Clusters, copies of one vector as a third of all rows, a row without a vector; few blocks are read."""
    monkeypatch.setattr(vector, "ROUND", rounds)
    rng = np.random.default_rng(6)
    x = clustered(rng, 2000)
    x[:700] = x[0]
    rows = [(f"c{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("none", None)]
    index = spark.createDataFrame(rows, "chunk_id string, vector array<float>").repartition(4)
    cells = vector.build_cell_index(index, cells=40, block=64)
    vector.write_cell_index(cells, str(tmp_path / "cells"))
    again = vector.read_cell_index(spark, str(tmp_path / "cells"))
    assert np.array_equal(again.centers, cells.centers) and cells.blocks.agg(F.sum("n")).first()[0] == 2000
    ids = [0, 3, 800, 900, 1000, 1999]
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "query_id int, vector array<float>")
    found = defaultdict(list)
    for r in vector.vector_search(queries, cells, 20, squared).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["chunk_id"])
    d = ((x[ids, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    score = np.round(1 / (1 + (d if squared else np.sqrt(d))), 9)
    assert all(found[q] == [f"c{i:04d}" for i in np.argsort(-score[j], kind="stable")[:20]] for j, q in enumerate(ids))
    bounds = [r[1:] for r in cells.blocks.select("n", "cell", "near", "far").collect()]
    to_center = np.sqrt(vector.distances(x[ids].astype(float), cells.centers))
    read = sum(int(vector.Bound(to_center, np.sort(np.sqrt(d), 1)[:, 19])(*b).sum()) for b in bounds)
    assert read < len(bounds) * len(ids) // 4


def test_many_queries_meet_a_block_in_parts(spark, monkeypatch):
    """Distances that are held at once are bounded, and so are a round's distances to the centres; results stay exact."""
    x = np.random.default_rng(4).normal(size=(400, 4)).astype(np.float32)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id int, vector array<float>")
    cells = vector.build_cell_index(index, cells=20, block=64)
    queries = index.withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(vector, "_PAIRS", 500)
    monkeypatch.setattr(vector, "ROUND", 400 * (4 + 20) * 8 // 3)
    sizes = []
    monkeypatch.setattr(vector, "_nearest", lambda cells, rows, *a, f=vector._nearest: (sizes.append(rows.num_rows), f(cells, rows, *a))[1])
    made = vector.vector_search(queries, cells, 3).orderBy("query_id", "rank").collect()
    score = np.round(1 / (1 + ((x[:, None].astype(float) - x[None]) ** 2).sum(2)), 9)
    assert [r["chunk_id"] for r in made] == np.argsort(-score, axis=1, kind="stable")[:, :3].ravel().tolist()
    assert sum(sizes) == 400 and len(sizes) == 3


def test_vector_search_moves_no_index(spark):
    index = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "chunk_id int, vector array<float>")
    queries = index.limit(3).withColumnRenamed("chunk_id", "query_id")
    plan = vector.vector_search(queries, index, 2)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if " Exchange " in line] and all("hashpartitioning(query_id" in line for line in plan.splitlines() if " Exchange " in line)


def test_embedding(spark, chunks, tmp_path):
    made = vector.build_vector_index(chunks, vector.hashing_embedder(16), str(tmp_path / "v")).first()
    assert (made["num_chunks"], made["embedding_dim"]) == (5, 16)
    assert vector.prefix_for("multilingual-e5", "query") == "query: " and vector.prefix_for("e5", "query", "") == "" and vector.prefix_for("other", "passage") == ""


def ranked(spark, lists):
    rows = [(1, n, r, c) for n, ids in lists.items() for r, c in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_id int, list_no int, rank int, chunk_id string")


def test_fusion(spark):
    lists = ranked(spark, {1: "ABC", 2: "BDA"})
    order = [r["chunk_id"] for r in fusion.reciprocal_rank_fusion(lists).orderBy("rank").collect()]
    assert order == ["B", "A", "D", "C"]
    assert fusion.reciprocal_rank_fusion(lists, top_n=2).count() == 2
    assert [r["chunk_id"] for r in fusion.reciprocal_rank_fusion(ranked(spark, {1: "XYZ"})).orderBy("rank").collect()] == list("XYZ")
    assert fusion.reciprocal_rank_fusion(lists.limit(0)).count() == 0
    assert [r["chunk_id"] for r in fusion.reciprocal_rank_fusion(ranked(spark, {1: "B", 2: "A"})).orderBy("rank").collect()] == ["A", "B"]


def test_rerank_with_scorer(spark, chunks):
    queries = spark.createDataFrame([(1, "board")], "query_id int, text string")
    candidates = chunks.select(F.lit(1).alias("query_id"), "chunk_id", "text")
    assert fusion.rerank(queries, candidates, top_n=1).first()["chunk_id"] == "c3"
    longest = lambda q, t: t.str.len().astype(float)
    assert fusion.rerank(queries, candidates, longest, 1).first()["chunk_id"] == "c1"


def pack(rows, budget, cap):
    """Row-at-a-time context packing for comparison."""
    taken, per_doc, used = [], {}, 0
    for _, cid, doc, text in sorted(rows):
        if cid in taken or per_doc.get(doc, 0) >= cap:
            continue
        cost = len(text) // 4 + 8
        if taken and used + cost > budget:
            break
        taken.append(cid)
        per_doc[doc] = per_doc.get(doc, 0) + 1
        used += cost
    return taken


def test_context(spark):
    rng = np.random.default_rng(2)
    rows = [(q, r, f"c{rng.integers(12)}", f"d{rng.integers(3)}", "t", "x" * int(rng.integers(1, 400))) for q in range(20) for r in range(1, 11)]
    rows = [(q, r, c, f"d{int(c[1:]) % 3}", t, x) for q, r, c, _, t, x in rows]
    made = store.build_context(spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, document_id string, title string, text string"), 200, 2)
    for r in made.collect():
        assert r["chunk_ids"] == pack([(k, c, d, x) for q, k, c, d, _, x in rows if q == r["query_id"]], 200, 2)


def test_store(spark, chunks):
    asked = spark.createDataFrame([(1, 1, "c4"), (1, 2, "no"), (1, 3, "c0"), (1, 4, "c4")], "req_id int, pos int, chunk_id string")
    rows = store.get_many_chunks(asked, chunks).orderBy("pos").collect()
    assert [r["chunk_id"] for r in rows] == ["c4", "c0", "c4"] and rows[0]["token_count"] == len(rows[0]["text"]) // 4 and rows[0]["start_char"] == 0
    assert {r["chunk_id"]: r["found"] for r in store.chunks_contain(asked.distinct(), chunks).collect()} == {"c4": True, "no": False, "c0": True}


def test_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}" + "x" * (600 if t == 11 else 0)) for t in range(12)] + [(2, 0, "user", "hi")]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert conversations.recent_turns(messages).where("conv_id = 1").count() == 8
    assert [r["evicted"] for r in conversations.evicted_turns(messages).collect()] == ["User: m2\nAssistant: m3"]
    summaries = spark.createDataFrame([(3, "earlier")], "conv_id int, summary string")
    context = {r["conv_id"]: r["context"] for r in conversations.conversation_context(messages, summaries, 4).collect()}
    assert context[3].endswith("earlier\n") and context[1].count("\n") == 6 and context[1].rstrip().endswith("…")


def test_evaluation_defaults(spark):
    runs = evaluation.results_to_runs(spark.createDataFrame([("q", None)], "question string, citations array<string>"))
    r = evaluation.compute_all_measures(runs).first()
    assert (r["citation_count"], r["unique_titles"], r["avg_citations_per_event"], r["total_latency_ms"]) == (0, 0, 0.0, 0.0)
    report = runs.select(evaluation.render_report("r", "now").alias("t")).first()["t"]
    for part in ("*No answer generated.*", "*No citations found in answer.*", "*No timeline extracted.*", "*No sources opened.*", "| Citations in answer | 0 |"):
        assert part in report


def test_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(1, "r", "a", 100.0), (2, "r", "a", 200.0), (3, "s", "a", 150.0)], "id int, run_id string, component_name string, duration_ms double")
    assert tuple(observability.component_stats(rows, "a").first()) == (3, 100.0, 200.0, 150.0)
    assert tuple(observability.component_stats(rows, "b").first()) == (0, 0.0, 0.0, 0.0)
    tokens = spark.createDataFrame([(None, 5, 10, 0.0), ("r", 5, 10, 500.0)], "run_id string, tokens_in int, tokens_out int, duration_ms double")
    observability.append_metrics(tokens, str(tmp_path / "t"))
    assert sorted((r["run_id"], r["tokens_per_second"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("r", 20.0), ("unknown", 0.0)]


def test_profiles_of_nothing(spark, articles):
    empty = articles.withColumn("text_length", F.length("text").cast("long")).limit(0)
    assert profiling.length_profile(empty).first()["count"] == 0
    assert profiling.markup_audit(empty).count() == 6
    assert profiling.length_profile(articles.withColumn("text_length", F.length("text").cast("long")), exact=False).first()["count"] == 5


@pytest.mark.parametrize("values", [[], [5], [1, 2], [3] * 40 + [9], list(range(0, 300, 7)) * 3, [None, 2, None, 10, 4]])
def test_exact_quantiles(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    shares = {"low": 0.0, "q": 0.25, "half": 0.5, "most": 0.9, "high": 1.0}
    made, known = ordering.quantiles(rows, "v", shares).first(), [v for v in values if v is not None]
    assert all(made[n] == (pytest.approx(np.quantile(known, q)) if known else None) for n, q in shares.items())


def test_rows_are_numbered_in_many_tasks(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 500).alias("o"), (F.col("id") % 3).alias("w")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["o"]: r["number"] for r in ordering.numbered(rows, "o").collect()}
        sums, total = ordering.running(rows, "o", weight=F.col("w"))
        plan = ordering.numbered(rows, "o")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {o: o + 1 for o in range(500)} and "SinglePartition" not in plan
    weights = {r["o"]: r["w"] for r in rows.collect()}
    assert total == sum(weights.values()) and all(r["before"] == sum(weights[o] for o in range(r["o"])) for r in sums.collect() if r["o"] % 50 == 0)


def test_summary_lines(spark):
    rows = [(2, "Why " * 40, 3, None, 1, 4, ""), (1, "How?", None, 2, 0, 0, "boom"), (3, "", 1, 1, 1, 1, None)]
    measured = spark.createDataFrame(rows, "question_id long, question string, citation_count int, unique_cited_titles int, timeline_item_count int, total_steps int, error string")
    got = [tuple(r) for r in evaluation.summary_lines(measured).orderBy("number").collect()]
    assert got == [(1, "| 1 | How? | — | 2 | 0 | 0 | Yes |"), (2, f"| 2 | {('Why ' * 40)[:60]} | 3 | — | 1 | 4 | — |"), (3, "| 3 |  | 1 | 1 | 1 | 1 | — |")]


def test_bucketed_lookups_leave_the_table(spark, tmp_path):
    """Only requests are shuffled, to the table's buckets."""
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"), F.lit("d").alias("document_id"), F.lit("T").alias("title"), F.lit("").alias("section"), F.col("id").cast("string").alias("text"))
    stored = store.write_chunk_store(rows, "bucketed_chunks", str(tmp_path / "store"), 4)
    asked = rows.select(F.lit(1).alias("req_id"), F.col("text").cast("int").alias("pos"), "chunk_id").where("pos % 3 = 0").union(spark.createDataFrame([(1, -1, "missing")], "req_id int, pos int, chunk_id string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (store.get_many_chunks(asked, stored), store.chunks_contain(asked, stored), store.open_top_n(asked.select(F.col("req_id").alias("query_id"), F.col("pos").alias("rank"), "chunk_id"), stored, 30)):
            found = made.collect()
            plan = made._jdf.queryExecution().executedPlan().toString()
            final = plan.split("== Initial Plan ==")[0]
            shuffled = [line for line in final.splitlines() if "Exchange hashpartitioning" in line]
            assert "Bucketed: true" in final and len(shuffled) == 1 and found, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_chunks")
    assert {r["pos"]: r["text"] for r in store.get_many_chunks(asked, rows).collect()} == {i: str(i) for i in range(0, 3000, 3)}


def test_retrieve_without_reranker(spark, chunks):
    merged = spark.createDataFrame([(1, 1, "c2", 0.9), (1, 2, "gone", 0.8), (1, 3, "c0", 0.7)], "query_id int, rank int, chunk_id string, score double")
    queries = spark.createDataFrame([(1, "x")], "query_id int, text string")
    for most in (None, 3):
        got = fusion.retrieve(queries, merged, chunks, 2, use_reranker=False, most=most).orderBy("rank").collect()
        assert [(r["chunk_id"], r["title"], r["snippet"]) for r in got] == [("c2", "T2", "A volcano erupts lava and ash"), ("gone", None, None)]
        assert [r["snippet"] for r in fusion.retrieve(queries, merged, chunks, 2, use_reranker=False, fill_snippets=False, most=most).collect()] == ["", ""]
        assert [r["chunk_id"] for r in fusion.retrieve(queries, merged, chunks, 5, score=lambda q, t: t.str.len().astype(float), most=most).orderBy("rank").collect()] == ["c0", "c2"]


def test_known_strings(spark, monkeypatch):
    texts = [(1, "abcd [ab] x"), (2, None), (3, ""), (4, "éa abc éa"), (5, "zzz"), (1, "abcd")]
    known = [("abc", 2), ("bc", 1), ("", 0), (None, 9), ("éa", 3), ("abc", 5), ("ab", 4), ("q", 6)]
    rows, names = spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(known, "known string, pos int")
    words = {k for k, _ in known if k}
    for size in (4 << 20, 3):
        monkeypatch.setattr(matching, "ROUND", size)
        found = matching.known_in_texts(rows, names)
        assert sorted(map(tuple, found.collect())) == sorted((i, k) for i, t in texts for k in words if t and k in t)
    cited = matching.citations_in_order(rows.where("text_id > 1"), names, matching.known_in_texts(rows.where("text_id > 1"), names))
    assert {r["text_id"]: r["cited"] for r in cited.collect()} == {2: [], 3: [], 4: ["bc", "abc", "éa", "ab", "abc"], 5: []}
    assert [tuple(r) for r in matching.known_tokens(rows, names, "\\[(\\w+)\\]").collect()] == [(1, "ab")]
    assert matching.known_in_texts(rows, names.limit(0)).count() == 0


def test_batches_by_length():
    rng = np.random.default_rng(7)
    lengths = rng.integers(0, 1000, 300)
    rows = list(models.by_length(lengths, 32))
    assert sorted(np.concatenate(rows)) == list(range(300)) and max(map(len, rows)) == 32
    padded = sum(int(lengths[r].max()) * len(r) for r in rows)
    plain = sum(int(lengths[a : a + 32].max()) * len(lengths[a : a + 32]) for a in range(0, 300, 32))
    assert padded < 0.6 * plain
    bounded = list(models.by_length(lengths, 32, 2000))
    assert sorted(np.concatenate(bounded)) == list(range(300)) and all(len(r) == 1 or lengths[r].max() * len(r) <= 2000 for r in bounded)
    assert models.run_by_length(lambda a, b: [x + y for x, y in zip(a, b, strict=True)], [["ccc", "", "a"], ["1", "2", "3"]], 2) == ["ccc1", "2", "a3"]
    assert models.run_by_length(lambda a: a, [[]], 2) == []


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os

        import numpy as np

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    def load_pairs():
        return lambda asked, texts: [len(q) + len(t) for q, t in zip(asked, texts, strict=True)]

    rows = spark.createDataFrame([(i, "x" * (i * 37 % 50)) for i in range(400)], "id int, text string").repartition(8)
    made = vector.embed_texts(rows, models.Model(f"count-{log}", load), batch=16, prefix="").collect()
    assert all(np.allclose(r["vector"], np.array([len(r["text"]), 1.0]) / np.hypot(len(r["text"]), 1.0)) for r in made) and len(made) == 400
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads))
    asked = spark.createDataFrame([(1, "abc")], "query_id int, text string")
    pairs = rows.where("id < 60").select(F.lit(1).alias("query_id"), F.format_string("c%03d", "id").alias("chunk_id"), "text")
    best = fusion.rerank(asked, pairs, models.Model(f"pairs-{log}", load_pairs), 3).collect()
    want = sorted(((-(3 + i * 37 % 50), f"c{i:03d}") for i in range(60)))[:3]
    assert sorted((-r["rerank_score"], r["chunk_id"]) for r in best) == want
