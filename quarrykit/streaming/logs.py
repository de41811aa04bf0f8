"""Run logs that arrive as files, taken up once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrykit.sources.tables import LOG


def take_up_logs(spark: SparkSession, path: str, table: str, checkpoint: str, files_at_once: int = 1000) -> DataFrame:
    """Appends the events of all `.jsonl` files of `path` that are new since the last call to `table`, and reads it.

    `checkpoint` remembers the files, and the file sink commits each batch once, so a call that is repeated or that failed
    before adds nothing twice. Blank lines go. A large backlog is taken up in batches of `files_at_once`.
    """
    events = spark.readStream.schema(LOG).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_at_once).json(path)
    found = events.where("event_type is not null")
    query = found.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(LOG).parquet(table)
