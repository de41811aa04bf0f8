"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_READ = 512


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; where it is unset, a folder in the warehouse, which executors share too."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quarrykit").rstrip("/")


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From here on Spark hands Python at most about `size` bytes at once (its default is 64 MB), as texts may be long.

    For the same reason Parquet is read by `ROWS_READ` rows at most: 4096, the default, are arrays of many MB on the heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    now = int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20}.get(unit, 30)
    if now <= 0 or now > size:
        spark.conf.set(key, size)
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(rows, min(int(spark.conf.get(rows)), ROWS_READ))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and return a reader of it: computed once, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` of which nothing is read any more."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def one_per_id(docs: DataFrame) -> DataFrame:
    """One row of each doc_id that is not null: the least by its text, then by all other comparable columns."""
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant"))]
    least = F.min_by(F.struct(*docs.columns), F.struct("text", *rest))
    return docs.where("doc_id is not null").groupBy("doc_id").agg(least.alias("least")).select("least.*")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bins_for(docs: DataFrame, text: str = "text", bytes_per_bin: int = 4 << 20, least: int = 128) -> int:
    """Bins so that each gets the keys of about `bytes_per_bin` bytes of text; grows in proportion to the input."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-total // bytes_per_bin))
