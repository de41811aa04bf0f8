"""Registered queries over chunks, embeddings and benchmark passages: search, fusion, reranking, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.operators import fusion, keyword, store, vector

from .corpus import FIXED, fixed_chunks, read
from .letters import counts_sql, letter_embedder, unit_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def asked(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def searched(spark, sf_dir: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """(results, chunks); the chunk table is planned once and its exchanges are reused."""
    chunks = fixed_chunks(spark, sf_dir)
    return keyword.bm25_search(asked(spark, sf_dir), keyword.build_keyword_index(chunks), chunks, k), chunks


BM25 = (
    FIXED
    + f""",
toks AS (SELECT chunk_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM chunks),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
posts AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY term, chunk_id),
terms AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM benchmark),
scores AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {keyword.K1 + 1} / (tf + {keyword.K1} * (1 - {keyword.B} + {keyword.B} * dl / avgdl))), 9) AS score FROM q JOIN terms USING (term) JOIN posts USING (term), size GROUP BY query_id, chunk_id),
bm AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM scores QUALIFY rank <= 20)"""
)


@query("keyword_index_terms", f"WITH {BM25} SELECT term, df FROM terms")
def keyword_index_terms(spark, sf_dir):
    return keyword.build_keyword_index(fixed_chunks(spark, sf_dir)).terms


@query("bm25_search", f"WITH {BM25} SELECT query_id, rank, chunk_id, round(score, 6) AS score, 'keyword' AS source, title, section, document_id, text FROM bm JOIN chunks USING (chunk_id)")
def bm25_search(spark, sf_dir):
    return searched(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


def context_sql(source: str, tokens: int = 2048, per_doc: int = 3) -> str:
    return f"""c1 AS (SELECT *, length(text) // 4 + 8 AS cost FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) = 1),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) <= {per_doc}),
c3 AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS run, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nr FROM c2),
ctx AS (SELECT query_id, string_agg('[' || title || '] (chunk ' || chunk_id || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context_text, list(chunk_id ORDER BY rank) AS chunk_ids, CAST(sum(cost) AS BIGINT) AS n_tokens FROM c3 WHERE run <= {tokens} OR nr = 1 GROUP BY query_id)"""


@query("flagship_contexts", f"WITH {BM25}, r AS (SELECT * FROM bm JOIN chunks USING (chunk_id) WHERE rank <= 5), {context_sql('r')} SELECT query_id, context_text, array_to_string(chunk_ids, ',') AS chunk_ids, n_tokens FROM ctx")
def flagship_contexts(spark, sf_dir):
    best, _ = searched(spark, sf_dir, 5)
    return store.build_context(best).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("build_context", f"WITH {BM25}, r AS (SELECT * FROM bm JOIN chunks USING (chunk_id)), {context_sql('r', 1000, 1)} SELECT query_id, context_text, array_to_string(chunk_ids, ',') AS chunk_ids, n_tokens FROM ctx")
def build_context(spark, sf_dir):
    return store.build_context(searched(spark, sf_dir)[0], 1000, 1).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


LEXICAL = f"""x AS (SELECT query_id, chunk_id, text FROM bm JOIN chunks USING (chunk_id)),
qt AS (SELECT query_id, list(term) AS qs FROM q GROUP BY query_id),
rr AS (SELECT x.query_id, x.chunk_id, x.text, round(len(list_intersect(qs, t)) / greatest(len(qs), 1), 9) AS rerank_score FROM x JOIN qt USING (query_id) JOIN toks USING (chunk_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM rr QUALIFY rank <= 5)"""


@query("rerank", f"WITH {BM25}, {LEXICAL} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, rank FROM top")
def rerank(spark, sf_dir):
    best, _ = searched(spark, sf_dir)
    return fusion.rerank(asked(spark, sf_dir), best.select("query_id", "chunk_id", "text")).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query("retrieve", f"WITH {BM25}, {LEXICAL} SELECT query_id, rank, chunk_id, round(rerank_score, 6) AS score, c.title, c.section, replace(substr(c.text, 1, 200), chr(10), ' ') AS snippet FROM top JOIN chunks c USING (chunk_id)")
def retrieve(spark, sf_dir):
    best, chunks = searched(spark, sf_dir)
    return fusion.retrieve(asked(spark, sf_dir), best, chunks, most=20).withColumn("score", F.round("score", 6))


@query("search_summaries", f"WITH {BM25} SELECT item_id AS query_id, CAST(count(bm.chunk_id) AS INT) AS n_results, string_agg(bm.chunk_id || ' ' || replace(substr(c.text, 1, 120), chr(10), ' '), '|' ORDER BY rank) AS results FROM benchmark LEFT JOIN bm ON bm.query_id = item_id AND rank <= 5 LEFT JOIN chunks c USING (chunk_id) WHERE trim(coalesce(benchmark.text, '')) <> '' GROUP BY item_id")
def search_summaries(spark, sf_dir):
    best, _ = searched(spark, sf_dir)
    made = store.search_summaries(asked(spark, sf_dir), best.withColumnRenamed("text", "snippet"))
    return made.withColumn("results", F.array_join(F.transform("results", lambda r: F.concat(r["chunk_id"], F.lit(" "), r["snippet"])), "|"))


@query("open_top_n", f"WITH {BM25} SELECT query_id AS req_id, rank AS pos, chunk_id, document_id, title, section, text, start_char, end_char, CAST(length(text) // 4 AS BIGINT) AS token_count FROM bm JOIN chunks USING (chunk_id) WHERE rank <= 3")
def open_top_n(spark, sf_dir):
    best, chunks = searched(spark, sf_dir)
    return store.open_top_n(best, chunks)


_REQUESTS = "SELECT doc_id AS req_id, CAST(i AS INT) AS pos, CASE WHEN i = 2 THEN 'missing' ELSE sha256(concat_ws('|', doc_id, 0, least(1000, length(text)), 'fixed_size', 'size=1000,overlap=200,min=100'))[1:16] END AS chunk_id FROM documents, unnest([1, 2, 3]) AS t(i) WHERE text <> ''"


def _requests(spark, sf_dir: str) -> DataFrame:
    from quarrykit.functions.text import make_chunk_id

    first = make_chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.least(F.lit(1000), F.length("text")), F.lit("fixed_size"), F.lit("size=1000,overlap=200,min=100"))
    rows = read(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("req_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos"), first.alias("id"))
    return rows.select("req_id", "pos", F.when(F.col("pos") == 2, "missing").otherwise(F.col("id")).alias("chunk_id"))


@query("get_many_chunks", f"WITH {FIXED}, r AS ({_REQUESTS}) SELECT req_id, pos, chunk_id, document_id, title, section, text, start_char, end_char, CAST(length(text) // 4 AS BIGINT) AS token_count FROM r JOIN chunks USING (chunk_id)")
def get_many_chunks(spark, sf_dir):
    return store.get_many_chunks(_requests(spark, sf_dir), fixed_chunks(spark, sf_dir))


@query("chunks_contain", f"WITH {FIXED}, r AS ({_REQUESTS}) SELECT r.chunk_id, r.chunk_id IN (SELECT chunk_id FROM chunks) AS found FROM r")
def chunks_contain(spark, sf_dir):
    return store.chunks_contain(_requests(spark, sf_dir), fixed_chunks(spark, sf_dir))


def vectors(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries: every tenth vector, index: all vectors)."""
    e = read(spark, sf_dir, "embeddings")
    return e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


VECTOR = """vs AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(1 / (1 + list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2)))), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0),
ve AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM vs QUALIFY rank <= 20)"""


@query("vector_search", f"WITH {VECTOR} SELECT query_id, rank, chunk_id, round(score, 6) AS score, 'vector' AS source FROM ve")
def vector_search(spark, sf_dir):
    return vector.vector_search(*vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("cosine_similarity", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, "a").select("a", "b", F.round(vector.cosine_similarity(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("index_summary", "SELECT count(*) AS num_chunks, max(len(embedding)) AS embedding_dim, count(*) AS rows_written FROM embeddings")
def index_summary(spark, sf_dir):
    return vector.index_summary(read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"))


def two_lists(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(BM25 and vector search over all fixed chunks, 20 of each query; chunks)."""
    best, chunks = searched(spark, sf_dir)
    index = vector.stored(vector.embed_texts(chunks.select("chunk_id", "text"), letter_embedder).drop("text"))
    return best, vector.vector_search(vector.embed_queries(asked(spark, sf_dir), letter_embedder), index), chunks


def rrf_sql(lists: str, n: int, k: str = "60", keys: str = "query_id") -> str:
    return f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, chunk_id) AS rank, chunk_id, s AS score FROM (SELECT {keys}, chunk_id, round(sum(1 / ({k} + rank)), 9) AS s FROM {lists} GROUP BY {keys}, chunk_id) QUALIFY rank <= {n}"


HYBRID = (
    f"{BM25}, qv AS (SELECT item_id AS query_id, {counts_sql('text')} AS c FROM benchmark WHERE text IS NOT NULL), cv AS (SELECT chunk_id, {counts_sql('text')} AS c FROM chunks), "
    f"qu AS MATERIALIZED (SELECT query_id, {unit_sql('c')} AS v FROM qv), cu AS MATERIALIZED (SELECT chunk_id, {unit_sql('c')} AS v FROM cv), "
    "vs AS (SELECT query_id, chunk_id, round(1 / (1 + list_sum(list_transform(list_zip(qu.v, cu.v), lambda p: pow(p[1] - p[2], 2)))), 9) AS score FROM qu, cu), "
    "ve AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM vs QUALIFY rank <= 20), "
    f"lists AS MATERIALIZED (SELECT 1 AS list_no, * FROM bm UNION ALL SELECT 2, * FROM ve), hy AS ({rrf_sql('lists', 50)})"
)


@query("hybrid_merge", f"WITH {HYBRID} SELECT query_id, rank, chunk_id, round(score, 6) AS score, 'hybrid' AS source FROM hy")
def hybrid_merge(spark, sf_dir):
    return fusion.hybrid_merge(*two_lists(spark, sf_dir)[:2]).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "source")


@query("confidence_check", f"WITH {BM25} SELECT item_id AS query_id, count(bm.chunk_id) AS n_retrieved, count(bm.chunk_id) < 2 AS needs_fallback FROM benchmark LEFT JOIN bm ON bm.query_id = item_id GROUP BY item_id")
def confidence_check(spark, sf_dir):
    return fusion.confidence_check(asked(spark, sf_dir), searched(spark, sf_dir)[0])


@query("sweep_rrf_k", f"WITH {HYBRID}, each_ AS (SELECT k, * FROM lists, unnest([1, 10, 30, 60, 120]) AS t(k)) SELECT query_id, k, rank, chunk_id, round(score, 6) AS score FROM ({rrf_sql('each_', 5, 'k', 'query_id, k')})")
def sweep_rrf_k(spark, sf_dir):
    return fusion.sweep_rrf_k(fusion.ranked_lists(*two_lists(spark, sf_dir)[:2])).select("query_id", "k", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("sweep_candidate_balance", f"WITH {HYBRID}, each_ AS (SELECT a AS keyword_n, b AS vector_n, lists.* FROM lists, (VALUES (5, 30), (20, 20), (30, 5)) AS t(a, b) WHERE rank <= CASE WHEN list_no = 1 THEN a ELSE b END) SELECT query_id, keyword_n, vector_n, rank, chunk_id, round(score, 6) AS score FROM ({rrf_sql('each_', 5, '60', 'query_id, keyword_n, vector_n')})")
def sweep_candidate_balance(spark, sf_dir):
    return fusion.sweep_candidate_balance(*two_lists(spark, sf_dir)[:2]).select("query_id", "keyword_n", "vector_n", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("score_distribution", f"WITH {VECTOR} SELECT query_id, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS gap FROM ve GROUP BY query_id")
def score_distribution(spark, sf_dir):
    made = fusion.score_distribution(vector.vector_search(*vectors(spark, sf_dir)))
    return made.withColumns({c: F.round(c, 6) for c in ("min_score", "max_score", "gap")})


RERANKED = """hx AS (SELECT query_id, chunk_id, text, title, section FROM hy JOIN chunks USING (chunk_id)), qt AS (SELECT query_id, list(term) AS qs FROM q GROUP BY query_id),
rr AS (SELECT hx.*, round(coalesce(len(list_intersect(qs, t)), 0) / greatest(coalesce(len(qs), 0), 1), 9) AS score FROM hx LEFT JOIN qt USING (query_id) JOIN toks USING (chunk_id)),
re AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score, text, title, section FROM rr QUALIFY rank <= 5)"""


@query(
    "retrieval_comparison",
    f"""WITH {HYBRID}, {RERANKED}, u AS (SELECT 'semantic' AS l, * FROM ve UNION ALL SELECT 'bm25', * FROM bm UNION ALL SELECT 'hybrid', * FROM hy UNION ALL SELECT 'reranked', query_id, rank, chunk_id, score FROM re)
SELECT query_id, chunk_id, {", ".join(f"max(CASE WHEN l = '{n}' THEN {c if c == 'rank' else 'round(score, 6)'} END) AS {n}_{c}" for n in ("semantic", "bm25", "hybrid", "reranked") for c in ("rank", "score"))}, coalesce(max(CASE WHEN l = 'reranked' THEN rank END), 6) <= 5 AS in_final FROM u GROUP BY query_id, chunk_id""",
)
def retrieval_comparison(spark, sf_dir):
    best, near, chunks = two_lists(spark, sf_dir)
    hybrid = fusion.hybrid_merge(best, near)
    reranked = fusion.rerank(asked(spark, sf_dir), hybrid.select("query_id", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id"))
    made = fusion.retrieval_comparison(near, best, hybrid, reranked)
    return made.withColumns({c: F.round(c, 6) for c in made.columns if c.endswith("_score")})


@query("hybrid_search", f"WITH {HYBRID} SELECT query_id, rank, chunk_id, round(score, 6) AS score, 'hybrid' AS source, c.title IS NOT NULL AS by_words FROM hy LEFT JOIN (SELECT query_id, chunk_id, title FROM bm JOIN chunks USING (chunk_id)) c USING (query_id, chunk_id)")
def hybrid_search(spark, sf_dir):
    """With the titles that only the keyword list brings: chunks without are found by vectors alone."""
    best, near, _ = two_lists(spark, sf_dir)
    return fusion.hybrid_merge(best, near).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "source", F.col("title").isNotNull().alias("by_words"))


@query("hybrid_retrieve", f"WITH {HYBRID}, {RERANKED} SELECT query_id, rank, chunk_id, round(score, 6) AS score, title, section, replace(substr(text, 1, 200), chr(10), ' ') AS snippet FROM re")
def hybrid_retrieve(spark, sf_dir):
    best, near, chunks = two_lists(spark, sf_dir)
    return fusion.retrieve(asked(spark, sf_dir), fusion.hybrid_merge(best, near), chunks, most=50).withColumn("score", F.round("score", 6))


_PLAIN = "SELECT query_id, rank, chunk_id, round(score, 6) AS score, title, section, {snippet} AS snippet FROM hy JOIN chunks USING (chunk_id) WHERE rank <= 7"


@query("retrieve_without_reranker", f"WITH {HYBRID} {_PLAIN.format(snippet=repr(''))} UNION ALL {_PLAIN.format(snippet='replace(substr(text, 1, 200), chr(10), chr(32))')}")
def retrieve_without_reranker(spark, sf_dir):
    """The fused list as it is, once without and once with snippets."""
    best, near, chunks = two_lists(spark, sf_dir)
    fused = fusion.hybrid_merge(best, near)
    plain, filled = (fusion.retrieve(asked(spark, sf_dir), fused, chunks, 7, most=50, use_reranker=False, fill_snippets=x) for x in (False, True))
    return plain.unionByName(filled).withColumn("score", F.round("score", 6))


@query("retrieve_with_scorer", f"WITH {HYBRID}, s AS (SELECT query_id, chunk_id, title, section, text, CAST(length(text) % 97 + length(b.text) % 7 AS DOUBLE) AS score FROM hy JOIN chunks USING (chunk_id) JOIN benchmark b ON item_id = query_id) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score, title, section, replace(substr(text, 1, 200), chr(10), ' ') AS snippet FROM s QUALIFY rank <= 3".replace("length(text) % 97", "length(chunks.text) % 97").replace("section, text, CAST", "section, chunks.text, CAST"))
def retrieve_with_scorer(spark, sf_dir):
    """A supplied scorer of (query, chunk) pairs; this one knows only their lengths, so that SQL can repeat it."""
    best, near, chunks = two_lists(spark, sf_dir)
    return fusion.retrieve(asked(spark, sf_dir), fusion.hybrid_merge(best, near), chunks, 3, most=50, score=lambda q, t: (t.str.len() % 97 + q.str.len() % 7).astype(float))
