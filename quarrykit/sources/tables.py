"""Chunk tables, run logs, questions."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, document_id string, title string, section string, text string, start_char long, end_char long, text_length long, chunker_name string, chunker_settings string"
LOG = "timestamp string, event_type string, level string, run_id string, run_type string, data string"
QUESTION = "id string, question string, topic string, expected_date_range string"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: in `spark.checkpoint.dir`, or in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From here on Spark hands Python at most about `size` bytes at once; its default is 64 MB, of which a task holds several copies."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).strip().lower()
    if not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(key, size)


def read_chunks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(CHUNKS).parquet(path)
    return rows.select(*columns) if columns else rows


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    chunks.write.mode(mode).parquet(path)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log events of all `.jsonl` files of a folder, `data` as JSON text; blank lines go; no file gives no rows."""
    try:
        rows = spark.read.schema(LOG).option("pathGlobFilter", "*.jsonl").json(path)
        return rows.where("event_type is not null")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def write_run_logs(logs: DataFrame, path: str) -> None:
    """Log events as `.jsonl` files; `data` stays JSON text."""
    logs.write.mode("overwrite").json(path)
    jvm, spark = logs.sparkSession.sparkContext._jvm, logs.sparkSession
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):  # one name per task
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".json"):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"{name.removesuffix('.json')}.jsonl"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array; every item needs id and question, else an error names the first bad ones.

    Text files (`.txt`) hold an array in parts, as `save_questions` writes it; any other file is an array of its own.
    """
    files = spark.read.text(path).inputFiles()
    parts, whole = [f for f in files if f.endswith(".txt")], [f for f in files if not f.endswith(".txt")]
    rows = spark.read.schema(QUESTION).option("multiLine", True).json(whole) if whole else spark.createDataFrame([], QUESTION)
    if parts:
        item = F.regexp_replace("value", "^\\[|[,\\]]$", "")
        lines = spark.read.text(parts).select(item.alias("item")).where("item <> ''")
        rows = rows.unionByName(lines.select(F.from_json("item", QUESTION).alias("x")).select("x.*"))
    bad = rows.where((F.coalesce("id", F.lit("")) == "") | (F.coalesce("question", F.lit("")) == "")).limit(5).collect()
    if bad:
        raise ValueError(f"questions without id or question: {[r.asDict() for r in bad]}")
    return rows


def save_questions(questions: DataFrame, path: str) -> None:
    """A folder with one JSON array in parts: its files one after the other, by name, are the array, with an item a line."""
    from quarrykit.operators.ordering import running

    item = F.to_json(F.struct("id", "question", "topic", "expected_date_range"))
    rows, total = running(questions.select("id", item.alias("item")), "id", "item")
    begin, end = F.when(F.col("before") == 0, "[").otherwise(""), F.when(F.col("before") == total - 1, "]").otherwise(",")
    lines = rows.select("before", F.concat(begin, "item", end).alias("value")) if total else questions.sparkSession.createDataFrame([(0, "[]")], "before long, value string")
    lines.repartitionByRange("before").sortWithinPartitions("before").select("value").write.mode("overwrite").text(path)


_BUCKET = "_bucket"


def upsert(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> int:
    """Puts `rows` into the table at `path` (Parquet, by buckets of `keys`); returns the number of buckets it has written.

    New keys are added, rows that differ replace those of their key, equal rows change nothing: a repeated or retried call
    leaves the table as it is. Of several rows with one key the greatest counts. Only buckets with a change are rewritten.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    given = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("new")) if rest else rows.distinct().withColumn("new", F.struct(F.lit(1)))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    given = given.withColumn(_BUCKET, bucket)
    names = lambda *more: [*keys, *((F.col("new")[c].alias(c) for c in rest)), *more]
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        old = None
    if old is None:
        out = given.select(*names(_BUCKET))
    else:
        body = F.struct(*rest) if rest else F.struct(F.lit(1))
        none = F.lit(None).cast(rows.select(body.alias("x")).schema["x"].dataType)
        both = rows.select(*keys, body.alias("new"), none.alias("old")).unionByName(old.select(*keys, none.alias("new"), body.alias("old")))
        met = both.groupBy(*keys).agg(F.max("new").alias("new"), F.max("old").alias("old"))  # one shuffle of either side
        changed = met.where(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).withColumn(_BUCKET, bucket).select(*names(_BUCKET))
        held = scratch(spark, "changed")
        changed.write.parquet(held)
        changed = spark.read.schema(changed.schema).parquet(held)
        touched = [r[0] for r in changed.select(_BUCKET).distinct().collect()]  # `buckets` rows at most
        if not touched:
            return 0
        new = changed.select(*(F.col(c).alias(f"_{c}") for c in keys))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        out = old.where(F.col(_BUCKET).isin(touched)).join(new, same, "left_anti").select(*rows.columns, _BUCKET).unionByName(changed)
    out = out.repartition(_BUCKET)
    n = out.select(_BUCKET).distinct().count() if old is None else len(touched)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)
    return n


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_BUCKET)
