"""MediaWiki dumps to pages and articles, and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions.text import strip_wiki_markup

PAGE = "title string, ns string, id string, redirect struct<_title: string>, revision struct<id: string, text: string>"
MANIFEST = "artifact_type string, source string, output string, counts map<string,bigint>, run_id string, created_at string"


def read_mediawiki_dump(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """title, ns, page_id, is_redirect, raw_text of every page of `.xml` or `.xml.bz2` files.

    `split=False` reads one file per task. `split=True` cuts even a single file into many tasks at page ends, which pays
    for large dumps; text before the first page (site information) and after the last one is left out.
    """
    if not split:
        pages = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
    else:
        parts = spark.read.option("lineSep", "</page>").text(path).where(F.contains("value", F.lit("<page>")))
        return parse_pages(parts.select(F.concat(F.expr("substring(value, instr(value, '<page>'))"), F.lit("</page>")).alias("xml")))
    return _flat(pages)


def parse_pages(rows: DataFrame) -> DataFrame:
    """The same columns from rows (xml) that hold one `<page>` element each."""
    return _flat(rows.select(F.from_xml("xml", PAGE, {"ignoreSurroundingSpaces": "false"}).alias("p")).select("p.*"))


def _flat(pages: DataFrame) -> DataFrame:
    trim = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    return pages.select(trim("title").alias("title"), trim("ns").alias("ns"), trim("id").alias("page_id"), F.col("redirect").isNotNull().alias("is_redirect"), F.col("revision.text").alias("raw_text"))


def select_main_articles(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("ns") == "0") & ~F.col("is_redirect") & (F.coalesce("title", F.lit("")) != "") & (F.coalesce("raw_text", F.lit("")) != ""))


def ingest_articles(pages: DataFrame, source: str, ingested_at: str, min_text_length: int = 50) -> DataFrame:
    """page_id, title, text, source, ingested_at, text_length of main articles with enough text."""
    text = select_main_articles(pages).select("page_id", "title", strip_wiki_markup(F.col("raw_text")).alias("text"))
    rows = text.where(F.length("text") >= min_text_length)
    return rows.select("page_id", "title", "text", F.lit(source).alias("source"), F.lit(ingested_at).alias("ingested_at"), F.length("text").cast("long").alias("text_length"))


def ingest_summary(pages: DataFrame, min_text_length: int = 50) -> DataFrame:
    """num_articles, total_chars, skipped (main articles with too little text)."""
    n = F.length(strip_wiki_markup(F.col("raw_text")))
    lengths = select_main_articles(pages).select(n.alias("n"))
    kept = F.col("n") >= min_text_length
    return lengths.agg(F.count_if(kept).alias("num_articles"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("total_chars"), F.count_if(~kept).alias("skipped"))


def write_manifest(spark: SparkSession, record: dict, path: str) -> None:
    """One build record; created_at is added if missing."""
    row = {k: record.get(k) for k in ("artifact_type", "source", "output", "counts", "run_id", "created_at")}
    made = spark.createDataFrame([tuple(row.values())], MANIFEST)
    made.withColumn("created_at", F.coalesce("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))).coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(MANIFEST).json(path)
    if rows.isEmpty():
        raise ValueError(f"the manifest at {path} is empty")
    return rows
