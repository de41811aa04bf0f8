"""Tables in the shared folder, bounded batches, one row of each doc_id."""

import os

import pytest

from quarrykit.llm import shared


def test_tables_are_written_and_deleted(spark):
    made = shared.materialize(spark.range(5), "five")
    folder = "/" + made.inputFiles()[0].rpartition("/")[0].removeprefix("file:").lstrip("/")
    assert made.count() == 5 and os.path.isdir(folder) and folder.startswith(shared.shared_dir(spark).removeprefix("file://"))
    shared.discard(made)
    assert not os.path.exists(folder)


def test_folder_without_a_setting():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}.get(key, default))

    assert shared.shared_dir(Session) == "hdfs://x/warehouse/quarrykit"


@pytest.mark.parametrize(("was", "now"), [("64m", "4194304"), ("67108864b", "4194304"), ("1k", "1k"), ("4096", "4096")])
def test_bounded_batches(spark, was, now):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, was)
    shared.bounded_batches(spark)
    assert spark.conf.get(key) in (now, f"{now}b")
    spark.conf.unset(key)


def test_parquet_is_read_in_short_batches(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    for was, now in (("4096", "512"), ("100", "100")):
        spark.conf.set(key, was)
        shared.bounded_batches(spark)
        assert spark.conf.get(key) == now
    spark.conf.unset(key)


def test_one_per_id(spark):
    rows = [(1, "b", "x"), (1, "a", "z"), (1, "a", "y"), (2, None, None), (2, None, None), (None, "c", "c")]
    made = shared.one_per_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(map(tuple, made.collect()), key=str) == [(1, "a", "y"), (2, None, None)]
