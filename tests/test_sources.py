import bz2
import json

import pytest

from quarrykit.sources import mediawiki, tables
from quarrykit.streaming import logs

BODY = "Some article text with [[links|shown]] that is long enough to be kept by the filter. &lt;ref&gt;x&lt;/ref&gt;"


def page(i, text=BODY, ns=0, extra=""):
    return f"  <page>\n    <title>Page {i}</title>\n    <ns>{ns}</ns>\n    <id>{i}</id>{extra}\n    <revision>\n      <id>{i}99</id>\n      <text xml:space=\"preserve\">{text}</text>\n    </revision>\n  </page>\n"


@pytest.fixture(scope="module", params=[False, True], ids=["whole", "split"])
def pages(request, spark, tmp_path_factory):
    xml = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">\n  <siteinfo><sitename>S</sitename></siteinfo>\n'
    xml += page(1) + page(2) + page(3, "short") + page(4, extra='<redirect title="Page 1" />') + page(5, ns=1) + "</mediawiki>\n"
    folder = tmp_path_factory.mktemp("dump")
    (folder / "a.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    return mediawiki.read_mediawiki_dump(spark, str(folder / "a.xml.bz2"), request.param)


def test_dump(pages):
    rows = {r["page_id"]: r for r in pages.collect()}
    assert set(rows) == {"1", "2", "3", "4", "5"} and rows["4"]["is_redirect"] and not rows["1"]["is_redirect"]
    kept = mediawiki.ingest_articles(pages, "dump", "now").collect()
    assert sorted(r["page_id"] for r in kept) == ["1", "2"] and all(r["text_length"] == len(r["text"]) and "[[" not in r["text"] and "ref" not in r["text"] for r in kept)
    s = mediawiki.ingest_summary(pages).first()
    assert (s["num_articles"], s["skipped"]) == (2, 1)
    assert mediawiki.ingest_articles(pages, "dump", "now", 0).count() == 3


def test_manifest(spark, tmp_path):
    mediawiki.write_manifest(spark, {"artifact_type": "articles", "counts": {"n": 2}}, str(tmp_path / "m"))
    r = mediawiki.read_manifest(spark, str(tmp_path / "m")).first()
    assert r["artifact_type"] == "articles" and r["counts"] == {"n": 2} and r["created_at"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="empty"):
        mediawiki.read_manifest(spark, str(tmp_path / "empty"))


def test_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp": "t", "event_type": "query", "level": "INFO", "data": {"query": "x"}}\n\n{"timestamp": "u", "event_type": "error"}\n')
    assert tables.read_run_logs(spark, str(tmp_path)).count() == 2
    assert tables.read_run_logs(spark, str(tmp_path / "none")).count() == 0


def test_questions(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Why?", "t", None), ("2", "How?", "t", "1900")], tables.QUESTION)
    tables.save_questions(rows, str(tmp_path / "q"))
    assert sorted(r["question"] for r in tables.load_questions(spark, str(tmp_path / "q")).collect()) == ["How?", "Why?"]
    (tmp_path / "bad.json").write_text('[{"id": "1"}]')
    with pytest.raises(ValueError, match="without id or question"):
        tables.load_questions(spark, str(tmp_path / "bad.json"))


def test_questions_in_parts(spark, tmp_path):
    """The files one after the other are one JSON array; an empty table is an empty array."""
    rows = spark.createDataFrame([(f"q{i:03d}", f'Why, "{i}"]?', "t,", None) for i in range(200)], tables.QUESTION).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.save_questions(rows, str(tmp_path / "q"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "q").glob("part-*.txt"))
    assert len(files) > 1 and [q["id"] for q in json.loads("".join(f.read_text() for f in files))] == [f"q{i:03d}" for i in range(200)]
    assert sorted(map(tuple, tables.load_questions(spark, str(tmp_path / "q")).collect())) == sorted(map(tuple, rows.collect()))
    tables.save_questions(rows.limit(0), str(tmp_path / "none"))
    assert tables.load_questions(spark, str(tmp_path / "none")).count() == 0


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v array<float>, n long")
    first = [(f"k{i}", [float(i)], i) for i in range(50)] + [(None, None, 1)]
    assert tables.upsert(frame(first), path, ["k"], 8) == 8
    files = sorted(p.name for p in (tmp_path / "table").rglob("*.parquet"))
    assert tables.upsert(frame(first[:20]), path, ["k"], 8) == 0 and sorted(p.name for p in (tmp_path / "table").rglob("*.parquet")) == files
    more = [("k3", [3.5], 3), ("k7", None, 7), ("new", [1.0], 1), ("new", [1.0], 1), (None, None, 2)]
    assert 0 < tables.upsert(frame(more), path, ["k"], 8) <= 4
    want = {r[0]: r for r in first} | {r[0]: r for r in more}
    got = tables.read_upserted(spark, path).select("k", "v", "n").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want.values(), key=str)
    assert tables.upsert(frame(more), path, ["k"], 8) == 0 and tables.upsert(frame([]), path, ["k"], 8) == 0


def test_log_files_are_taken_up_once(spark, tmp_path):
    def write(name, n):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(f'{{"timestamp": "{name}{i}", "event_type": "query", "data": {{"query": "x"}}}}\n\n' for i in range(n)))
        return logs.take_up_logs(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint"), 1)

    assert write("a.jsonl", 3).count() == 3
    assert write("b.txt", 5).count() == 3
    again = write("c.jsonl", 4)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, tables.read_run_logs(spark, str(tmp_path / "in")).collect()), key=str) and again.count() == 7
    (tmp_path / "in" / "c.jsonl").touch()
    assert logs.take_up_logs(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")).count() == 7


@pytest.mark.parametrize("packed", [False, True])
def test_one_large_dump_is_read_in_many_tasks(spark, tmp_path, packed):
    """A single file, compressed or not, is split, and every page is read once."""
    pages = "".join(page(i, BODY * 20) for i in range(1500))
    data = f"<mediawiki>\n{pages}</mediawiki>\n".encode()
    name = tmp_path / ("dump.xml.bz2" if packed else "dump.xml")
    name.write_bytes(bz2.compress(data, 1) if packed else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(name.stat().st_size // 6))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.maxsize", str(name.stat().st_size // 6))
    try:
        rows = mediawiki.read_mediawiki_dump(spark, str(name), split=True)
        assert rows.rdd.getNumPartitions() > 1
        assert sorted(int(r["page_id"]) for r in rows.select("page_id").collect()) == list(range(1500))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.input.fileinputformat.split.maxsize")
