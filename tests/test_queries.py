"""Every registered query with an SQL twin gives the twin's rows on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrykit import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    made = catalog.QUERIES[name](spark, SF)
    cols = sorted(made.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in made.collect())
    assert rows
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert rows == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())


ODD = ["Doó ciónado", "isé?", "is it", "is_it", "is1", "DÓ", "did文", "are you", "which", "1 + 1 ", "1 + 1\n", "2*2\u0085", "", None]


def odd_questions(spark, folder, name, texts=ODD):
    """Rows of a query and of its SQL on questions with letters, marks and line ends beyond ASCII."""
    spark.createDataFrame([(i, t, "user", x) for i, x in enumerate(texts) for t in (0, 1)], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    made = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    found = con.execute(f"SELECT {', '.join(made.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(tuple, made.collect())), sorted(found)


def test_heuristic_route_of_odd_questions(spark, tmp_path):
    made, found = odd_questions(spark, tmp_path, "heuristic_route")
    assert made == found and {r[2] for r in made} == {"math", "local_rag", "ambiguous"}


@pytest.mark.parametrize("name", ["heuristic_route", "resolve_route"])
def test_routes_of_vertical_tabs_and_dotted_capitals(spark, tmp_path, name):
    texts = ["\x0bis it", "is it\x0b", "1+1\x0b", "1\x0b2", "\x0b1+1", " \x0b\n", "\u0130s it", "how much \u0130s 2", "\u0130", "is\u0130", "1+1\u2028", " is it\u0085"]
    made, found = odd_questions(spark, tmp_path, name, texts)
    assert made == found


def test_resolve_route_of_odd_questions(spark, tmp_path):
    made, found = odd_questions(spark, tmp_path, "resolve_route")
    assert made == found and {r[3] for r in made} == {"heuristic", "llm", "fallback"}


def cut_pages(spark, folder, name):
    """Rows of a query and of its SQL on pages whose titles are cut anywhere, within references too; 15 ids show each to every status and type."""
    title = 'a &amp; "b" &quot;c&quot; &#39;d&#39; &lt;e&gt; &copy; f &middot;'
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>{0}<b>x{0}y</b></body></html>"
    cuts = [title[:i] for i in range(len(title) + 1)] + ["&amplt;", "&ampx", "&amp;amp;", "&amp;quot;", "&notit;", "&copyright", "&quot&quot;", "&lt &gt", "&#;", "&;", "&unknown;"]
    rows = [(15 * i + j, f"http://a/{i}", page.format(x)) for i, x in enumerate(cuts) for j in range(15)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    made = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    found = con.execute(f"SELECT {', '.join(made.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(tuple, made.collect()), key=str), sorted(found, key=str)


def test_html_text_of_references_cut_short(spark, tmp_path):
    made, found = cut_pages(spark, tmp_path, "extract_html_text")
    assert made == found and any(r[1].startswith('a & "b" &quot\n') for r in made)


def test_page_text_of_references_cut_short(spark, tmp_path):
    made, found = cut_pages(spark, tmp_path, "extract_pages")
    assert made == found and any(r[2].startswith('a & "b" &quot\n') for r in made) and len({r[5] for r in made}) == 2


@pytest.mark.parametrize("name", ["extract_pages", "extract_html_text", "hybrid_merge"])
def test_python_gets_small_batches(spark, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, 64 << 20)
    catalog.QUERIES[name](spark, SF)
    count = F.pandas_udf(lambda pages: pages.map(lambda _: len(pages)), "int")
    rows = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("page"))
    assert rows.select(count("page").alias("n")).agg(F.max("n")).first()[0] < 600


def test_citations_of_texts_reads_texts_once(spark):
    plan = catalog.QUERIES["citations_of_texts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_citations_of_texts_with_repeated_ids(spark, tmp_path):
    """Texts of one doc_id are one answer of the first four chunks of them all."""
    rows = [(1, "ab [c]\n\n" * 700, "en", "s", 1), (2, "x" * 3299, "en", "s", 1), (3, "y " * 1650, "en", "s", 1), (4, "", "en", "s", 1), (5, None, "en", "s", 1), (6, "z" * 3400, "en", "s", 1), (6, "z" * 900, "en", "s", 1), (6, "z" * 1000, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = {r["question_id"]: r for r in catalog.QUERIES["citations_of_texts"](spark, str(tmp_path)).collect()}
    assert {k: r["opened_count"] for k, r in made.items()} == {"1": 4, "2": 4, "3": 4, "6": 4}


@pytest.mark.parametrize("name", ["vector_search", "score_distribution"])
def test_every_tenth_vector_is_asked(spark, name):
    asked = {i for (i,) in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 10 = 0").select("vec_id").collect()}
    assert {r["query_id"] for r in catalog.QUERIES[name](spark, SF).collect()} == asked and len(asked) == 50
