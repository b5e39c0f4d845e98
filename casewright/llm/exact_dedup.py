"""Exact dedup: a stateful stream over digests, its state on disk, and the full bytes of whatever it hits (no Python on executors)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, note, of_files, shared_dir, stage

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each of many small stores sets aside megabytes before it holds a row
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Groups of more than 1 / HOT of all rows are fewer than HOT, so they may be broadcast.
HOT = 1000


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def stream_groups(digests: DataFrame, bodies: DataFrame, files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of equal digests by a stream over the staged table ``digests``, and the digests that stand for several texts.

    The state lives in RocksDB on the executors' disks, is logged to the shared folder, never expires, and holds for each
    digest the number of rows and, of the row with the largest doc_id, that id and the locator (file and row) of its
    text. Each batch writes the groups it changed; one that runs again overwrites its own folder. After the last batch the
    hits are checked, once however many batches there were: texts under a digest that several rows have are grouped by
    their full bytes (``bodies``: digest, body, top), and one whose row with the largest doc_id is not the one that the
    state's locator names is another text. The stream has a session of its own, so no setting of the caller's changes.
    """
    spark = digests.sparkSession
    home = f"{shared_dir(spark)}/dedup-stream-{uuid.uuid4().hex}"
    note(home)
    own = spark.newSession()
    for k, v in (_STORE | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)
    reader = own.readStream.schema(digests.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    groups = reader.parquet(digests.staged_path).groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count("*").alias("group_size"))
    schema, other = groups.schema, "digest binary"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/groups/batch={number}")

    query = groups.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    batches = query.lastProgress["batchId"] + 1 if query.lastProgress else 0
    if not batches:
        return spark.createDataFrame([], schema), spark.createDataFrame([], other)
    found = spark.read.schema(schema).option("basePath", f"{home}/groups").parquet(f"{home}/groups").select(*schema.fieldNames())
    if batches > 1:
        found = stage(found.groupBy("digest").agg(F.max("top").alias("top"), F.max("group_size").alias("group_size")), "dedup-groups")
    hits = found.filter("group_size > 1").select("digest", F.col("top.locator").alias("at"))
    return found, bodies.join(hits, "digest").filter(F.col("top.locator") != F.col("at")).select("digest").distinct()


def classes(docs: DataFrame, files_per_trigger: int | None = None, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, digest, locator, other) and the groups (digest, other, top, group_size) of equal texts.

    ``other`` is the text itself under a digest that stands for several texts, else null, so such a digest gives as many
    groups as texts. top: doc_id and locator of the row that stays.
    """
    rows = keyed(docs, "dedup-docs")
    body = F.coalesce(F.col("doc.text"), F.lit("")).cast("binary")
    full = rows.select(F.col("doc.doc_id").alias("doc_id"), body.alias("body"), digest(body).alias("digest"), F.struct(F.col("__file").alias("file"), F.col("__row").alias("row")).alias("locator"))
    none = F.lit(None).cast("binary")
    digests = stage(full.select("doc_id", "digest", "locator"), "dedup-digests")
    # equal texts meet before they are shuffled
    bodies = full.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count("*").alias("group_size"))
    groups, unequal = stream_groups(digests, bodies, files_per_trigger)
    members, groups = digests.withColumn("other", none), groups.select("digest", none.alias("other"), "top", "group_size")
    unequal = stage(unequal, "dedup-unequal")
    if not unequal.isEmpty():
        split = bodies.join(unequal, "digest").select("digest", F.col("body").alias("other"), "top", "group_size")
        groups = groups.join(unequal, "digest", "left_anti").unionByName(split)
        apart = full.join(unequal, "digest").select("doc_id", "digest", "locator", F.col("body").alias("other"))
        members = members.join(unequal, "digest", "left_anti").unionByName(apart)
    return members, groups


def dedup(docs: DataFrame, files_per_trigger: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every document with its group of equal texts; the row with the largest doc_id of a group stays.

    A null text counts as empty, so null and empty texts are one group. Rows that repeat a doc_id with the same text are
    the same document and share its verdict; a null doc_id stays only in a group that has no other. Texts of one digest
    are compared in full bytes; should a digest stand for several texts, each is a group of its own. Further columns do
    not matter; texts are read whole, of any length; an empty table gives an empty result.
    Returns doc_id, keep_id, group_size, kept, text_sha256, locator (file and row of the row that stays).
    """
    members, groups = classes(docs, files_per_trigger, digest)
    g = groups.select(F.col("digest").alias("d"), F.col("other").alias("o"), "top", "group_size")
    same = (F.col("digest") == F.col("d")) & F.col("other").eqNullSafe(F.col("o"))
    limit = members.count() / HOT
    # fewer than HOT rows, whatever the input
    hot = F.broadcast(stage(g.filter(F.col("group_size") > limit), "dedup-hot"))
    large = members.join(hot, same)
    small = members.join(hot, same, "left_anti").join(g.filter(F.col("group_size") <= limit), same)
    out = large.unionByName(small)
    keep = F.col("top.doc_id")
    return out.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("top.locator").alias("locator"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``documents`` table."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("locator")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts: the one whose locator the state holds (largest doc_id, then file and row; null last).

    Rows stay by their own place in the input, not by doc_id, so repeated and null ids rescue no copies.
    """
    docs = docs if of_files(docs) else stage(docs, "dedup-rows")
    rows = keyed(docs, "dedup-rows")
    kept = classes(docs)[1].select(F.col("top.locator.file").alias("__file"), F.col("top.locator.row").alias("__row"))
    return rows.join(kept, ["__file", "__row"], "left_semi").select("doc.*")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
