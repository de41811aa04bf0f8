"""From raw documents to packed sequences: each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import crf, jaccard, langid, packing, repeats
from quarrykit.llm.shared import materialize, read_table

LEAST_SHARE = 0.4  # share of a document's letters that its language must have


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose letters are mostly of one learned language; `lang` becomes that language.

    Null texts and texts without a letter go; repeated rows are judged alike; without any language nothing stays.
    """
    model = langid.learn(docs.where(langid.fold() != 1))
    made = langid.label_texts(docs, model, spans=False).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return made.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the line field finds good.

    Empty texts have the base rate of the labels; repeated rows are judged alike; without labels everything stays.
    """
    field = crf.learn(docs, read_table(spark, sf_dir, "labels"))
    return crf.score_documents(docs, field).where("quality_score >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of every group of near copies (five words, similarity 0.8).

    Texts without words are nobody's copies and stay, as rows without doc_id do; of rows with one doc_id the least stays.
    """
    return jaccard.one_per_group(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes word runs that an earlier document has; documents of which no word is left go.

    What stays keeps its white space, and texts without a repeat stay as they are, null and empty ones too. Rows without
    doc_id take no part and stay; rows of one doc_id are cut alike.
    """
    made = repeats.remove_repeats(docs, joined=False)
    return made.where("n_words = 0 or n_removed < n_words").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens.

    An empty text is one piece of the separator; repeated rows are packed as often as they occur.
    """
    return packing.pack_documents(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
