"""Language ID, line classifier, divergence rules, host reputation, licence scan and pipeline."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import crf, divergence, langid, licences, urls

SF = "/root/testdata/sf0.01"


def labelled(spark, column, table):
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()}


def test_language_accuracy(spark):
    truth, texts = labelled(spark, "lang", "documents"), labelled(spark, "text", "documents")
    rows = langid.op2_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.98


def test_language_learns_from_the_fold_only(spark):
    rows = [(i, f"alpha beta {i}" if i % 2 else f"gamma delta {i}", "a" if i % 2 else "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.col("doc_id").isin([i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1])
    other = docs.withColumn("lang", F.when(held, "wrong").otherwise(F.col("lang")))
    made = [sorted(map(tuple, langid.identify(d, False).select("doc_id", "lang_pred", "score").collect())) for d in (docs, other)]
    assert made[0] == made[1]


def best_path(scores, switch):
    """Plain Viterbi of one sequence."""
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        step = value[None] - switch * (1 - np.eye(len(value)))
        back.append(step.argmax(1))
        value = s + step.max(1)
    total = value.max()
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], total


def test_viterbi():
    rng = np.random.default_rng(4)
    count = np.array([5, 0, 1, 40, 3])
    begin = np.cumsum(count) - count
    scores = rng.normal(size=(count.sum(), 3)) * 3
    label = langid.viterbi(scores, begin, count, 2.0)
    for b, n in zip(begin, count, strict=True):
        if n:
            mine = scores[b : b + n]
            _, best = best_path(mine, 2.0)
            got = label[b : b + n]
            assert abs(mine[np.arange(n), got].sum() - 2.0 * (got[1:] != got[:-1]).sum() - best) < 1e-9


def test_viterbi_of_many_labels():
    want = np.repeat([3, 127, 128, 199, 150], 4)
    scores = np.zeros((len(want), 200))
    scores[np.arange(len(want)), want] = 9.0
    assert langid.viterbi(scores, np.array([0, 12]), np.array([12, 8]), 2.0).tolist() == want.tolist()


def test_two_hundred_languages(spark):
    rows = [(i, " ".join(f"{a}{chr(97 + i % 20)}{chr(97 + i // 20)}{a}q" for a in "bcdfg"), f"l{i:03}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    made = langid.label_texts(docs.select("doc_id", "text"), langid.learn(docs)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in made} == {i: name for i, _, name in rows}
    assert all({s["lang"] for s in r["spans"]} == {r["lang_pred"]} for r in made)


def test_mixed_text_gets_spans(spark):
    train = [(i, "the and of with that this from " * 5 if i % 2 else "и не на что он был для как " * 5, "en" if i % 2 else "ru") for i in range(60)]
    model = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    text = "this that with the of " * 4 + "он был для как что " * 4
    (r,) = langid.label_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(s["lang"], s["n_words"]) for s in r["spans"]] == [("en", 20), ("ru", 20)]


def test_language_edge_cases(spark, docs, nothing):
    empty = langid.learn(nothing)
    assert empty.langs == [] and langid.label_texts(nothing, empty).count() == 0
    assert {r["lang_pred"] for r in langid.label_texts(docs, empty).collect()} == {"und"}
    made = langid.identify(docs)
    assert made.count() == docs.count() and {"source", "n_words"} < set(made.columns)


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_quality_accuracy(spark):
    truth = labelled(spark, "quality", "labels")
    rows = crf.op7_quality_classifier(spark, SF).collect()
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    score, label = (np.array(x) for x in zip(*held, strict=True))
    assert auc(score, label) > 0.95 and np.mean((score >= 0.5) == label) > 0.93
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(6)
    count, moves = np.array([3, 0, 1, 4]), rng.normal(size=(2, 2))
    begin = np.cumsum(count) - count
    score = rng.normal(size=count.sum())
    p, expected = crf.marginals(score, moves, begin, count)
    want_moves = np.zeros((2, 2))
    for b, n in zip(begin, count, strict=True):
        if not n:
            continue
        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        w = np.exp([sum(score[b + i] * y for i, y in enumerate(p_)) + sum(moves[a, c] for a, c in zip(p_, p_[1:], strict=False)) for p_ in paths])
        w /= w.sum()
        assert np.allclose(p[b : b + n], [sum(x for x, q in zip(w, paths, strict=True) if q[i]) for i in range(n)])
        for x, q in zip(w, paths, strict=True):
            for a, c in zip(q, q[1:], strict=False):
                want_moves[a, c] += x
    assert np.allclose(expected, want_moves)


def test_quality_edge_cases(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8, 80)] + [(9, 0, 0), (None, 1, 0), (10, None, 0)], "doc_id long, quality int, toxic int")
    field = crf.learn(docs, labels)
    rows = crf.score_documents(docs, field).collect()
    assert len(rows) == docs.count() and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert crf.score_documents(nothing, field).count() == 0
    untrained = crf.learn(docs, labels.limit(0))
    assert {r["quality_score"] for r in crf.score_documents(docs, untrained).collect()} == {0.5}


def test_quality_learns_without_rows_of_python(spark, monkeypatch):
    """Rows of Python would pass through workers of their own kind, which stay idle beside those of the other steps."""
    docs = spark.createDataFrame([(i, f"line {i}\nand one more") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("rows of Python"))
    assert len(crf.learn(docs, labels).weights)


def test_quality_passes_over_texts_that_do_not_fit(spark):
    """A text over the limit that comes first by its hash changes nothing for all others."""
    rows = [(i, ["plain words of a line", "# $ % | <>"][i % 2] + f" {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = docs.where(langid.fold() != 1)
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", 1000)).otherwise(F.col("text")))
    field = crf.learn(long, labels, sample_bytes=5000)
    want = crf.learn(docs.where(F.col("doc_id") != first), labels)
    assert len(field.weights) and np.allclose(field.weights, want.weights) and np.allclose(field.moves, want.moves)


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_base_counts(spark, docs, nothing, texts):
    more = dict(texts) | {100: "a\na\n\n\na b\na ", 101: "# * é $$\n\n# * é $$", 102: "x\n"}
    frame = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    refs = divergence.references(docs)
    for r in divergence.judge(frame, refs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(more[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert divergence.judge(nothing, refs).count() == 0
    assert divergence.judge(docs, divergence.references(nothing)).count() == docs.count()


def test_js_distance():
    p, q = np.array([[1.0, 3.0, 0.0], [0.0, 0.0, 0.0]]), np.array([0.5, 0.25, 0.25])
    m = (np.array([0.25, 0.75, 0]) + q) / 2
    want = np.sqrt((0.25 * np.log2(0.25 / m[0]) + 0.75 * np.log2(0.75 / m[1]) + (q * np.log2(q / m)).sum()) / 2)
    assert np.allclose(divergence.js_distance(p, q), [want, 1.0])


def test_divergence_separates(spark):
    truth = labelled(spark, "quality", "labels")
    rows = [r for r in divergence.op6_distribution_divergence(spark, SF).collect() if r["doc_id"] in truth and not r["base_failed"]]
    good = [r["kept"] for r in rows if truth[r["doc_id"]] == 1]
    bad = [r["kept"] for r in rows if truth[r["doc_id"]] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_urls_equal_sql(spark):
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(map(tuple, urls.op4_host_reputation(spark, SF).select(cols).collect()), key=repr)
    assert got == sorted(c.execute(f"SELECT {', '.join(cols)} FROM ({urls.ORACLE})").fetchall(), key=repr)


def test_url_rules(spark):
    cases = {
        "http://A.NET/x": ("a.net", "/x", "net/"), "http://net": ("net", "", None), "http://sub.example.net/en/1?q": ("sub.example.net", "/en/1", "example.net/en/"), "x://example.net/enx": ("example.net", "/enx", "net/"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None), "http://example.com/de/#a": ("example.com", "/de/", "example.com/de/"), "nothing": ("", "", None), "http://h.org?x=://y/": ("h.org", "", None), "http://ü.ORG/fr/é": ("ü.org", "/fr/é", "org/fr/"),
    }
    pages = spark.createDataFrame([*enumerate(cases), (99, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, good long")
    rules = spark.createDataFrame(urls.RULES, "action string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge_pages(pages, rules, none).collect()}
    assert got == {**dict(enumerate(cases.values())), 99: ("", "", None)}
    assert urls.judge_pages(pages.limit(0), rules, none).count() == 0


def test_reputation_blocks_bad_hosts(spark):
    outcomes = [(f"h{i}.good.org", 1) for i in range(5) for _ in range(40)] + [("bad.evil.org", 0)] * 60 + [("new.evil.org", 0)]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["h1.good.org", "bad.evil.org", "unseen.net"])], "page_id long, url string")
    made = urls.judge_pages(pages, spark.createDataFrame([], "action string, rule string"), spark.createDataFrame(outcomes, "host string, good long"))
    assert {r["host"]: r["verdict"] for r in made.collect()} == {"h1.good.org": "allow", "bad.evil.org": "block", "unseen.net": "allow"}


def test_reputation_on_given_pages(spark):
    """Hosts of the given pages differ by chance only; one whose labels are turned bad is blocked by evidence alone."""
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    outcomes = urls.page_outcomes(pages, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    worst = Counter(r["host"] for r in outcomes).most_common(1)[0][0]
    none = spark.createDataFrame([], "action string, rule string")
    for planted, blocked in ((None, set()), (worst, {worst})):
        rows = [(r["host"], 0 if r["host"] == planted else r["good"]) for r in outcomes]
        made = urls.judge_pages(pages, none, spark.createDataFrame(rows, "host string, good long"))
        assert {r["host"] for r in made.where("verdict = 'block'").select("host").distinct().collect()} == blocked


def test_beta_bound(spark):
    """Against quantiles of samples."""
    rng = np.random.default_rng(3)
    cases = [(0.7, 0.4), (1.0, 1.0), (5.5, 2.0), (60.0, 9.0), (900.0, 140.0)]
    made = spark.createDataFrame(cases, "a double, b double").select(urls.beta_bound(F.col("a"), F.col("b"), urls.Z).alias("q")).collect()
    for (a, b), r in zip(cases, made, strict=True):
        assert abs((rng.beta(a, b, 200_000) <= r["q"]).mean() - 0.95) < 0.03


@pytest.fixture(scope="module")
def scanner(spark):
    return licences.Scanner(spark, spark.read.parquet(f"{SF}/documents.parquet"), 800)


def test_licences(spark, scanner):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted({r["doc_id"] for r in scanner.scan(docs).collect()})
    assert got == sorted(r["doc_id"] for r in docs.where("text like '%icense%'").collect())
    cases = [
        (1, "intro\nReleased under the MIT License.\nend", "MIT"), (2, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "Apache-2.0"), (3, "This driver is licensed under protest and the apache roamed.", None), (4, None, None), (5, "", None),
        (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to use it", "MIT"), (7, "word " * 3000 + "\nLicensed under CC BY-NC 4.0.", "CC-BY-NC"),
    ]
    frame = spark.createDataFrame([c[:2] for c in cases] + [cases[0][:2]], "doc_id long, text string")
    found = [(r["doc_id"], r["family"]) for r in scanner.scan(frame).collect()]
    assert sorted(found) == sorted([(i, f) for i, _, f in cases if f] + [(1, "MIT")])
    assert scanner.scan(frame.limit(0)).count() == 0


def test_wrapped_licences_and_families(spark, scanner):
    import textwrap

    first = lambda family, i=0: licences.TEMPLATES[family][i]
    wrap = lambda text, width, lead="": "\n".join(textwrap.wrap(text, width, initial_indent=lead, subsequent_indent=lead))
    whole = {f: max(licences.TEMPLATES[f], key=len) for f in ("AGPL", "Apache-2.0", "BSD", "GPL", "ISC", "LGPL", "MIT")}
    texts = {}
    for family, text in whole.items():
        for width in (20, 40, 78, 2000):
            texts[f"{family} {width}"] = (f"some words here\n\n{wrap(text, width)}\n \nmore", {family})
    texts["comment"] = ("/*\n" + wrap(whole["GPL"], 70, " * ") + "\n */", {"GPL"})
    texts["inside"] = ("words of a text\n" + wrap(whole["MIT"], 60) + "\nand the end", {"MIT"})
    texts["both"] = (wrap(whole["MIT"], 50) + "\n" + wrap(whole["Apache-2.0"], 50), {"MIT", "Apache-2.0"})
    texts["lines"] = (first("MIT") + "\n" + first("GPL"), {"MIT", "GPL"})
    texts["short"] = ("Licensed under the GNU Lesser General Public License, version 3.", {"LGPL"})
    texts["isc"] = ("Released under the ISC License.", {"ISC"})
    texts["spdx"] = ("# SPDX-License-Identifier: MIT\nint x;", {"MIT"})
    texts["spdx list"] = ("// SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-or-later)", {"Apache-2.0", "GPL"})
    texts["spdx lgpl"] = ("SPDX-License-Identifier: LGPL-2.1-only", {"LGPL"})
    texts["apart"] = ("Released under the\n\nMIT License.", set())
    texts["none"] = ("The software is for any person\nwho wants to publish\nand to share a copy of the files.", set())
    found = {}
    for r in scanner.scan(spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "doc_id string, text string")).collect():
        found.setdefault(r["doc_id"], []).append(r["family"])
    assert {k: sorted(found.get(k, [])) for k in texts} == {k: sorted(v[1]) for k, v in texts.items()}
    again = [("a", f"x\n\n{wrap(whole['BSD'], 50)}\n\ny\nz\n\n{wrap(whole['BSD'], 50)}")]
    rows = scanner.scan(spark.createDataFrame(again, "doc_id string, text string")).collect()
    lines = again[0][1].split("\n")
    assert len(rows) == 2 and all(lines[r["paragraph"]] in wrap(whole["BSD"], 50) for r in rows)


def plain_licences(scanner, texts):
    """(doc_id, paragraph, family, coverage) by a plain scan: every line and block against every template, without anchors."""
    families = scanner.families
    weights, base = scanner.model.coefficientMatrix.toArray(), scanner.model.interceptVector.toArray()
    column = {g: i for i, g in enumerate(scanner.vocab)}
    words = lambda t: [x for x in (re.sub(r"^[.-]+|[.-]+$", "", p) for p in re.sub(r"[^\w.-]|_", " ", t.lower()).split()) if x]
    grams = lambda t: set(licences._grams(words(t)))
    known = {f: [grams(t) for t in ts] for f, ts in licences.TEMPLATES.items()}

    def families_of(unit):
        found = []
        for f, ts in known.items():
            cover, matched = max((len(unit & t) / len(t), sorted(unit & t)) for t in ts)
            if cover < licences.COVER:
                continue
            own = unit & set().union(*ts)
            score = base + weights[:, [column[g] for g in own]].sum(1)
            p = np.exp(score - score.max())
            found.append((f, cover, set(matched), p[families.index(f)] / p.sum()))
        beaten = lambda f: any(g[1] > f[1] and len(f[2] - g[2]) <= (1 - licences.COVER) * len(f[2]) for g in found)
        return [f for f in found if not beaten(f) and f[3] >= scanner.least]

    out = []
    for doc, text in texts:
        lines = [(i, x) if x.strip(" \t\n\v\f\r") else None for i, x in enumerate((text or "").split("\n"))]
        block = []
        for line in [*lines, None]:
            if line is not None:
                block.append(line)
                continue
            single = [(i, f) for i, x in block for f in families_of(grams(x))]
            out += [(doc, i, f[0], round(f[1], 4)) for i, f in single]
            for f in families_of(grams(" ".join(x for _, x in block))) if len(block) > 1 else []:
                if f[0] not in {g[0] for _, g in single}:
                    at = max(block, key=lambda x: (len(grams(x[1]) & f[2]), -x[0]))[0]
                    out.append((doc, at, f[0], round(f[1], 4)))
            block = []
    return sorted(out)


def test_licences_against_a_plain_scan(spark, scanner):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    row = lambda r: (r["doc_id"], r["paragraph"], r["family"], round(r["coverage"], 4))
    got = sorted(row(r) for r in scanner.judge(*scanner.found).collect())
    assert got and got == plain_licences(scanner, texts)
    every = [(n, text) for n, text in enumerate(t for ts in licences.TEMPLATES.values() for t in ts)]
    every += [(1000 + n, "before\n" + text.replace(" ", "\n", 7) + "\nafter\n\n" + every[n - 5][1] + "\n" + text) for n, text in every]
    frame = spark.createDataFrame(every, "doc_id long, text string").repartition(7)
    assert sorted(row(r) for r in scanner.scan(frame).collect()) == plain_licences(scanner, every)
    families = {n: f for n, f in enumerate(f for f, ts in licences.TEMPLATES.items() for _ in ts)}
    found = {d: f for d, _, f, _ in plain_licences(scanner, every) if d < 1000}
    assert {n: f for n, f in families.items() if found.get(n) != f} == {}


def test_licence_sets_do_not_meet_all_families(spark, scanner):
    sets = spark.createDataFrame([("a", 2, ["released under", "under the", "mit license"]), ("b", 1, ["isc license"])], "set_id string, n long, grams array<string>")
    made = {(r["set_id"], r["family"]): r for r in scanner._covered(sets).collect()}
    assert ("b", "ISC") in made and len([k for k in made if k[0] == "b"]) == 1 and made["a", "MIT"]["matched"] == sorted(made["a", "MIT"]["matched"])
    assert "CartesianProduct" not in (plan := scanner._covered(sets)._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan


def test_licence_limit_from_all_documents_in_any_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, two = (licences.Scanner(spark, x, 40) for x in (docs.repartition(7, "text"), docs.orderBy(F.desc("doc_id")).coalesce(1)))
    assert one.least == two.least and one.model.coefficientMatrix.toArray().tolist() == two.model.coefficientMatrix.toArray().tolist()
    ids = [r[0] for r in spark.range(100).orderBy(F.xxhash64("id")).collect()]
    near = "Permission is hereby granted, free of charge, to any person obtaining a copy of this file"
    made = lambda other: spark.createDataFrame([(i, "a few plain words" if i == ids[0] else other) for i in ids], "doc_id long, text string")
    assert licences.Scanner(spark, made("more plain words"), 8).least == licences.LEAST < licences.Scanner(spark, made(near), 8).least


def test_anchors_lose_nothing(spark):
    anchors = licences.anchors(spark)
    for family, w, grams in licences.templates(spark).select("family", "w", "grams").collect():
        kept = [g for g in set(grams) if not any(a in g for a in anchors)]
        assert len(kept) < licences.COVER * len(set(grams)), (family, w)


def test_pipeline(spark, tmp_path, docs, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.drop("score", "n_words").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(8, 60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    made = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = made.columns
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"] for r in made.collect()}
        out = stage(spark, made, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out-{name}"))
        made = spark.read.parquet(str(tmp_path / f"out-{name}"))
        after = {r["doc_id"] for r in made.collect()}
        assert after <= before and after
        assert name == "pack" or made.columns == columns
    assert pipeline.run(spark, str(tmp_path)).count() == made.count()
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
