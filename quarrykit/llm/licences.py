"""License scans (8): a trained paragraph classifier over sparse word n-grams, confirmed by template comparison.

Units are lines with a word and, as licences are mostly hard-wrapped, paragraphs: runs of such lines, joined, which a
blank line ends. Their 2- and 3-word n-grams, as far as they occur in the templates, are the features of a multinomial
logistic regression with an L1 penalty (so few weights stay). It learns licence families from the templates and from cut
pieces of them, and the class `unknown` from corpus lines. Units with the same n-grams are judged once: their n-grams meet
the templates' in an equi-join, so a set has rows only for families that it shares an n-gram with. Each family is judged by
itself, from the n-grams of its own templates, so that two licences side by side are both found. The probability that a
family needs is calibrated on the unconfirmed candidates of all documents: `QUANTILE` of them stay below it (in steps of
0.0001; candidates without n-grams count as 0). A prediction counts only if a template of the family shares at least `COVER`
of its n-grams with the unit, and if no other family explains the shared n-grams better (a notice of the AGPL holds nearly
all of the GPL's).

A result's `paragraph` is the number of its line. A paragraph's family that no single line of it shows has the number of
the line that shares most n-grams with the family's closest template.

All DataFrame operations and Spark ML, no Python in tasks. A paragraph that no template can confirm is left out early: it
holds none of the words (`anchors`) that any sufficient share of a template's n-grams must contain. The learning sample is bounded by `SAMPLE` lines,
chosen by hash and so the same in every run; calibration and scanning cover every paragraph of every text.

Defined cases: null and empty texts have no paragraphs; repeated rows give repeated results; an empty table gives no rows;
extra columns are ignored. A family counts once per paragraph if it is found by joined lines only.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

SAMPLE = 4000  # corpus paragraphs at most that stand for `unknown`
QUANTILE, LEAST, COVER = 0.999, 0.5, 0.6

FILLED, MARK = "[^\\x20\\x09-\\x0D]", "\x01"

#: Fixed: words that say little about a licence.
COMMON = {"under", "this", "work", "with", "that", "the", "any", "and", "only", "following", "author", "file", "form", "later", "version", "which", "other", "public", "general", "person"}
#: Fixed: notices and opening sentences by which licences are recognised, by family.
TEMPLATES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "Licensed under the ISC License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "public domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    ],
}
#: Fixed: identifiers of SPDX lines, by family; each gives a template of its own.
SPDX = {
    "AGPL": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "Apache-2.0": ["Apache-2.0"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "CC-BY": ["CC-BY-3.0", "CC-BY-4.0"],
    "CC-BY-NC": ["CC-BY-NC-3.0", "CC-BY-NC-4.0"],
    "CC-BY-NC-ND": ["CC-BY-NC-ND-3.0", "CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA": ["CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0"],
    "CC-BY-ND": ["CC-BY-ND-3.0", "CC-BY-ND-4.0"],
    "CC-BY-SA": ["CC-BY-SA-3.0", "CC-BY-SA-4.0"],
    "GPL": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "ISC": ["ISC"],
    "LGPL": ["LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT"],
    "MPL-2.0": ["MPL-2.0"],
    "public domain": ["CC0-1.0", "Unlicense"],
}
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {x}" for x in _ids]


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits, dots and hyphens, without marks at their ends."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}.-]+", " "), " ")
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, "^[.-]+|[.-]+$", "")), lambda w: w != "")


def ngrams(w: Column) -> Column:
    """All 2- and 3-word n-grams of an array of words, in order, with repeats."""
    two = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    three = F.zip_with(two, F.slice(w, 3, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    clean = lambda grams, drop: F.slice(grams, 1, F.greatest(F.size(w) - drop, F.lit(0)))
    return F.concat(clean(two, 1), clean(three, 2))


def templates(spark: SparkSession) -> DataFrame:
    """family, template (a number), w, grams of every template."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    made = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "template int, family string, text string")
    return made.select("family", "template", words(F.col("text")).alias("w")).select("*", ngrams(F.col("w")).alias("grams"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number of the line), line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.where(F.col("line").rlike(FILLED))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block: each run of filled lines, every line led by its number and a mark."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike(FILLED), F.concat(i.cast("string"), F.lit(MARK), x)).otherwise(""))
    return docs.select("doc_id", F.explode(F.split(F.array_join(numbered, "\n"), "\n\n+")).alias("block")).where("block <> ''")


def vocabulary(spark: SparkSession) -> list[str]:
    """Distinct n-grams of the templates: fixed in size by the templates."""
    return sorted(r[0] for r in templates(spark).select(F.explode("grams")).distinct().collect())


def _grams(w: list[str]) -> list[str]:
    return [" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)]


def anchors(spark: SparkSession, cover: float = COVER) -> list[str]:
    """Words of which every paragraph that shares `cover` of a template's n-grams must hold one.

    Per template its longest words (common ones last) are taken until the n-grams without any of them are too few.
    """
    out: set[str] = set()
    for (w,) in templates(spark).select("w").collect():  # the templates, fixed in number
        left = set(_grams(w))
        least = cover * len(left)
        for x in sorted(set(w), key=lambda x: (x in COMMON, -len(x), x)):
            if len(left) < least:
                break
            out.add(x)
            left = {g for g in left if x not in g.split(" ")}
    return sorted(x for x in out if not any(y != x and y in x for y in out))


def any_anchor(anchor_words: list[str]):
    by_letter = {c: [re.escape(x[1:]) for x in anchor_words if x[0] == c] for c in sorted({x[0] for x in anchor_words})}
    any_of = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return lambda text: text.rlike(any_of)


def plain_line(numbered: Column) -> Column:
    """A numbered line's text, lower-cased. In an SPDX expression every identifier gets the tag before it."""
    line = F.lower(F.regexp_replace(numbered, f"^\\d+{MARK}", ""))
    return F.when(line.contains("spdx-license-identifier:"), F.regexp_replace(line, " (?:or|and) +", " spdx-license-identifier ")).otherwise(line)


def candidates(docs: DataFrame, anchor_words: list[str]) -> tuple[DataFrame, DataFrame]:
    """(blocks that hold an anchor: block_id, doc_id, lines; their units: block_id, doc_id, paragraph, single, set_id, grams).

    No other unit can be confirmed. `grams` has the distinct n-grams that any template has, sorted, and set_id is their
    digest; a unit is a line that holds an anchor (`single`) or all lines of a block.
    """
    holds = any_anchor(anchor_words)
    texts = docs.select("doc_id", "text").where(holds(F.lower("text")))
    found = blocks(texts).where(holds(F.lower("block"))).select(F.monotonically_increasing_id().alias("block_id"), "doc_id", F.filter(F.split("block", "\n"), lambda x: x != "").alias("numbered"))
    number = lambda x: F.substring_index(x, MARK, 1).cast("int")
    lines = F.transform("numbered", lambda x: F.struct(number(x).alias("paragraph"), plain_line(x).alias("line")))
    kept = materialize(found.select("block_id", "doc_id", lines.alias("lines")), "blocks")  # so that block_id stays
    line = kept.select("block_id", "doc_id", F.explode("lines").alias("l")).select("block_id", "doc_id", "l.paragraph", F.lit(True).alias("single"), "l.line").where(holds(F.col("line")))
    joined = kept.where("size(lines) > 1").select("block_id", "doc_id", F.col("lines")[0]["paragraph"].alias("paragraph"), F.lit(False).alias("single"), F.array_join("lines.line", " ").alias("line"))
    known = vocabulary(docs.sparkSession)
    units = line.unionByName(joined).withColumn("w", words(F.col("line"))).drop("line")
    grams = F.sort_array(F.array_distinct(F.filter(ngrams(F.col("w")), lambda g: g.isin(known))))
    units = units.select("block_id", "doc_id", "paragraph", "single", grams.alias("grams"))
    return kept, units.select("block_id", "doc_id", "paragraph", "single", F.sha2(F.array_join("grams", "\n"), 256).alias("set_id"), "grams")


class Scanner:
    """The fitted classifier with its calibrated probability; `found` has the candidates of the documents that it was made from."""

    def __init__(self, spark: SparkSession, docs: DataFrame, sample: int = SAMPLE):
        self.spark, self.vocab = spark, vocabulary(spark)
        self.families = ["unknown", *sorted(TEMPLATES)]
        self.counts = CountVectorizerModel.from_vocabulary(self.vocab, "grams", "features")
        self.known = known = templates(spark)
        size = F.size("w")
        cut = lambda a, n: F.slice("w", a, F.greatest(n, F.lit(2)))
        pieces = F.array(F.col("w"), cut(F.lit(1), F.ceil(size * 0.8).cast("int")), cut(F.greatest(F.ceil(size * 0.2).cast("int"), F.lit(1)), size))
        positive = known.select("family", F.explode(pieces).alias("w")).select("family", ngrams(F.col("w")).alias("grams"))
        chosen = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, sample // 8))
        lines = paragraphs(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi"))
        lines = lines.orderBy(F.xxhash64("doc_id", "paragraph"), "doc_id", "paragraph", "line").limit(sample).select(words(F.col("line")).alias("w")).select(ngrams(F.col("w")).alias("grams"))
        cover = known.select(F.col("grams").alias("template"))
        alike = F.broadcast(cover).where("size(template) > 0")
        unknown = lines.join(alike, F.size(F.array_intersect("grams", "template")) >= COVER * F.size(F.array_distinct("template")), "left_anti")
        index = F.array_position(F.array(*(F.lit(x) for x in self.families)), F.col("family")) - 1
        rows = positive.unionByName(unknown.withColumn("family", F.lit("unknown"))).withColumn("label", index.cast("double"))
        weight = F.when(F.col("family") == "unknown", 0.05).otherwise(1.0)
        rows = self.counts.transform(rows.withColumn("weight", weight).coalesce(1)).cache()
        self.model = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=30, weightCol="weight").fit(rows)
        rows.unpersist()
        self.found = self._scored(docs)
        scored, sets = self.found[2], self.found[1].where("size(grams) = 0").agg(F.lit(0.0).alias("p"), F.count("*").alias("n"))
        best = scored.groupBy("set_id", "n").agg(F.max("probability").alias("p"), F.max("coverage").alias("most"))
        unconfirmed = best.where(F.col("most") < COVER).select("p", "n").unionByName(sets.where("n > 0"))
        steps = unconfirmed.groupBy(F.round("p", 4).alias("p")).agg(F.sum("n").alias("n"))  # 10001 rows at most
        limit = steps.agg(F.expr(f"percentile(p, {QUANTILE}, n)")).first()[0]
        self.least = min(0.95, max(LEAST, limit or 0.0))

    def _scored(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """`candidates` of `docs` and set_id, n (units), family, coverage, matched, probability of their sets of n-grams."""
        kept, units = candidates(docs, anchors(self.spark))
        units = materialize(units, "units")
        sets = units.where("size(grams) > 0").groupBy("set_id").agg(F.first("grams").alias("grams"), F.count("*").alias("n"))
        return kept, units, materialize(self._probable(self._covered(sets)), "sets")

    def _covered(self, sets: DataFrame) -> DataFrame:
        """Each set with every family that it shares n-grams with (grams), coverage by its closest template, matched (shared with it).

        Of templates that cover as much, the one whose shared n-grams are last in order counts as the closest.
        """
        each = self.known.select("family", "template", F.array_distinct("grams").alias("t")).where("size(t) > 0")
        each = each.select("family", F.explode("t").alias("gram"), F.struct("template", F.size("t").alias("size")).alias("of"))
        held = each.groupBy("gram", "family").agg(F.collect_list("of").alias("of"))  # fixed in size by the templates
        met = sets.select("set_id", "n", F.explode("grams").alias("gram")).join(F.broadcast(held), "gram")
        met = met.groupBy("set_id", "n", "family").agg(F.sort_array(F.collect_list(F.struct("gram", "of"))).alias("met"))  # n-grams of one family's templates
        shared = lambda t: F.transform(F.filter("met", lambda x: F.array_contains(x["of"], t)), lambda x: x["gram"])
        by = F.transform(F.array_distinct(F.flatten("met.of")), lambda t: F.struct(t["size"].alias("size"), shared(t).alias("matched")))
        met = met.select("set_id", "n", "family", F.col("met.gram").alias("grams"), by.alias("by"))
        closest = F.array_max(F.transform("by", lambda x: F.struct((F.size(x["matched"]) / x["size"]).alias("coverage"), x["matched"].alias("matched"))))
        return met.withColumn("_closest", closest).select("set_id", "n", "family", "grams", "_closest.*")

    def _probable(self, covered: DataFrame) -> DataFrame:
        """The probability of the row's family, by the n-grams of its own templates, in place of these."""
        scored = self.model.transform(self.counts.transform(covered))
        index = F.array_position(F.array(*(F.lit(x) for x in self.families)), F.col("family")) - 1
        return scored.select("set_id", "n", "family", "coverage", "matched", F.get(vector_to_array("probability"), index.cast("int")).alias("probability"))

    def judge(self, kept: DataFrame, units: DataFrame, scored: DataFrame) -> DataFrame:
        """doc_id, paragraph, family, probability, coverage of the units of `_scored` that are found to be a licence's."""
        met = scored.where(F.col("coverage") >= COVER)
        whole = met.groupBy("set_id").agg(F.collect_list(F.struct("family", "probability", "coverage", "matched")).alias("fs"))  # as many as families
        better = lambda f, g: (g["coverage"] > f["coverage"]) & (F.size(F.array_except(f["matched"], g["matched"])) <= (1 - COVER) * F.size(f["matched"]))
        left = F.filter("fs", lambda f: ~F.exists("fs", lambda g: better(f, g)))
        accepted = whole.select("set_id", F.explode(left).alias("f")).select("set_id", "f.*").where(F.col("probability") >= self.least)
        hits = units.drop("grams").join(accepted, "set_id")
        hits = hits.withColumn("_alone", F.max("single").over(Window.partitionBy("block_id", "family"))).where(F.col("single") | ~F.col("_alone"))
        shares = lambda x: F.size(F.array_intersect(ngrams(words(x["line"])), F.col("matched")))
        at = F.array_max(F.transform("lines", lambda x: F.struct(shares(x).alias("n"), (-x["paragraph"]).alias("p"))))
        wrapped = hits.where("not single").join(kept.select("block_id", "lines"), "block_id").withColumn("paragraph", -at["p"])
        cols = ["doc_id", "paragraph", "family", "probability", "coverage"]
        return hits.where("single").select(*cols).unionByName(wrapped.select(*cols))

    def scan(self, docs: DataFrame) -> DataFrame:
        """`judge` of the candidates of `docs`."""
        return self.judge(*self._scored(docs))


def op8_licence_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanner = Scanner(spark, docs)
    found = scanner.judge(*scanner.found)
    return found.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("probability", 4).alias("probability"), F.round("coverage", 4).alias("coverage"))
