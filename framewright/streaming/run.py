"""Running a streaming plan to the end of its input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from framewright.session import scratch_path


def drain(stream: DataFrame, tag: str, mode: str = "append", timeouts: bool = False) -> DataFrame:
    """Process all available input into Parquet in the shared folder and read it back.

    The last batch may be one without data, which emits the windows and sessions that the watermark has closed.
    ``timeouts`` says that the plan holds processing-time timeouts: such batches would then follow each other for ever and
    are switched off while it runs.  ``complete`` and ``update`` results are written per trigger with the trigger
    number in ``_batch``; the caller keeps the last version it wants.
    """
    spark: SparkSession = stream.sparkSession
    base = scratch_path(spark, tag)
    out, state = f"{base}/rows", f"{base}/state"
    flag = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(flag)
    if timeouts:
        spark.conf.set(flag, "false")
    try:
        _run(stream, out, state, mode)
    finally:
        if timeouts:
            spark.conf.set(flag, before)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.option("basePath", out).parquet(f"{out}/_batch=*")


def _run(stream: DataFrame, out: str, state: str, mode: str) -> None:
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        return

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    writer.outputMode(mode).foreachBatch(save).start().awaitTermination()


class VersionedTable:
    """Rows by key, published trigger by trigger: of each key the row of the highest version counts.

    A trigger's rows are written under its own number, so running a trigger again leaves the table as it was.  Every
    ``full``-th version also holds what stood before it, so a read looks at ``full`` versions at most.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, full: int = 16):
        self.spark, self.path, self.keys, self.full = spark, path, list(keys), full
        self.schema = StructType([f for f in schema if f.name != "_batch"])
        self.rest = [f.name for f in self.schema if f.name not in self.keys]
        spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{path}/_batch=-1")  # so that there is something to read

    def put(self, rows: DataFrame, number: int) -> None:
        """Publish the changed rows of trigger ``number``; one row a key."""
        rows = rows.select(*self.keys, *self.rest)
        if number % self.full == 0 and number:
            rows = self._newest(self._versions(number).unionByName(rows.withColumn("_batch", F.lit(number).cast("long"))))
        rows.write.mode("overwrite").parquet(f"{self.path}/_batch={number}")

    def _versions(self, before: int | None = None) -> DataFrame:
        """The newest full version and those after it, all below ``before``."""
        schema = StructType(self.schema.fields).add("_batch", "long")
        all_of = self.spark.read.schema(schema).parquet(self.path)
        if before is None:
            newest = all_of.agg(F.max("_batch")).first()[0]
            before = 0 if newest is None else newest + 1
        start = (before - 1) // self.full * self.full
        return all_of.where(F.col("_batch").between(start, before - 1))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = F.max_by(F.struct(*self.rest), "_batch").alias("_r")
        return rows.groupBy(*self.keys).agg(rest).select(*self.keys, "_r.*")

    def current(self, before: int | None = None) -> DataFrame:
        """The table as it stands, or as it stood before trigger ``before``."""
        return self._newest(self._versions(before))


def publish(stream: DataFrame, table: VersionedTable, every: str, state: str) -> StreamingQuery:
    """Publish the rows that changed to ``table`` each ``every`` (update mode); ``state`` is the checkpoint folder.

    A key with a null part is a key of its own.
    """
    return (stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(processingTime=every)
            .foreachBatch(lambda rows, number: table.put(rows, number)).start())


def published(stream: DataFrame, keys: Sequence[str], tag: str, every: str = "1 second") -> VersionedTable:
    """Publish all input there is, then stop; returns the table."""
    base = scratch_path(stream.sparkSession, tag)
    table = VersionedTable(stream.sparkSession, f"{base}/rows", keys, stream.schema)
    query = publish(stream, table, every, f"{base}/state")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return table
