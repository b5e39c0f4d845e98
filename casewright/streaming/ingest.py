"""Incremental ingest as one structured stream: new files, one row per key, keyed merge into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_rows(spark: SparkSession, path: str, schema: T.StructType, key: str, at: str | None = None, delay: str = "30 days", form: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream of a folder's files with each key once; with an event time, state older than ``delay`` is dropped."""
    reader = spark.readStream.schema(schema).format(form)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)
    if at:
        return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def run_available(rows: DataFrame, sink, checkpoint: str, mode: str = "append") -> int:
    """Processes what is there and stops; ``sink`` gets (batch, number) and must bear being called again for a number."""
    q = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    q.awaitTermination()
    return q.lastProgress["batchId"] + 1 if q.lastProgress else 0


def into_table(table: str, key: str):
    """A sink that appends a batch's rows to a Parquet folder in a place of its own, so that a repeated batch changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return sink


def read_table(spark: SparkSession, table: str, schema: T.StructType, key: str) -> DataFrame:
    """What the batches left, each key once (the earliest batch's)."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(table)
    first = rows.groupBy(key).agg(F.min("batch").alias("_b")).withColumnRenamed(key, "_k")
    return rows.join(first, (F.col(key) == F.col("_k")) & (F.col("batch") == F.col("_b"))).drop("_k", "_b", "batch")


def latest_rows(spark: SparkSession, table: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """What the batches left, each key as the latest batch that has it."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(table)
    values = [c for c in schema.fieldNames() if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def windowed_counts(rows: DataFrame, at: str, kind: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """start, kind, n in event-time windows; works on streams and tables alike."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
