"""Known ids, urls or names in texts: which of many known strings occur anywhere in each of many texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUND = 4 << 20  # characters of the known strings of one automaton


def _automaton(known: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for i, word in enumerate(known):
        made.add_word(word, i)
    made.make_automaton()
    return made


def known_in_texts(texts: DataFrame, known: DataFrame, key: str = "text_id", name: str = "known") -> DataFrame:
    """key, known: every different known string (column `known`) that occurs in a text, once for each row of `texts`.

    Occurrence is plain: `abc` is in `abcd`. Each task reads its texts once, with an automaton of all known strings; no
    text meets each string. Known strings go to the tasks in rounds of about `ROUND` characters by hash, each a pass of
    its own. Null and empty strings and null texts occur nowhere.
    """
    spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
    words = known.where(F.col(name) != "").select(F.col(name).alias("known")).distinct()
    rounds = max(1, -(-(words.agg(F.sum(F.length("known"))).first()[0] or 0) // ROUND))
    made = None
    for i in range(rounds):
        own = words.where(F.pmod(F.xxhash64("known"), F.lit(rounds)) == i) if rounds > 1 else words
        asked = own.toArrow()["known"].combine_chunks()  # of one round
        if not len(asked):
            continue
        shared = spark.sparkContext.broadcast(asked)

        def run(batches, shared=shared):
            words = shared.value
            automaton = _automaton(words.to_pylist())
            for batch in batches:
                rows, found = [], []
                for row, text in enumerate(batch.column(1)):
                    hits = {i for _, i in automaton.iter(text.as_py())}
                    found += hits
                    rows += [row] * len(hits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), words.take(pa.array(found, pa.int64()))], [key, "known"])

        part = texts.where("text is not null").select(key, "text").mapInArrow(run, f"`{key}` {kind}, known string")
        made = part if made is None else made.union(part)
    return spark.createDataFrame([], f"`{key}` {kind}, known string") if made is None else made


def known_tokens(texts: DataFrame, known: DataFrame, pattern: str, key: str = "text_id", name: str = "known") -> DataFrame:
    """As `known_in_texts`, where known strings stand only as whole matches of `pattern`'s first group: an equi-join.

    For sets of known strings of any size: texts are cut into tokens where they are, and only tokens meet the strings.
    """
    tokens = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("known"))
    words = known.where(F.col(name) != "").select(F.col(name).alias("known")).distinct()
    return tokens.join(words, "known", "left_semi").select(key, "known")


def citations_in_order(texts: DataFrame, known: DataFrame, found: DataFrame, key: str = "text_id", name: str = "known") -> DataFrame:
    """key, cited: per text the found strings in the order of `known` (columns `known`, pos); repeated ones stay."""
    rows = found.join(known.where(F.col(name) != "").select(F.col(name).alias("known"), "pos"), "known")
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "known"))).alias("x"))
    cited = F.coalesce(F.transform("x", lambda x: x["known"]), F.array().cast("array<string>"))
    return texts.select(key).join(listed, key, "left").select(key, cited.alias("cited"))
