"""Queries of model hooks with stand-ins for models, of files read one by one, and of windows checked against golden ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright.operators import models
from casewright.operators import temporal as t
from casewright.sources import io
from casewright.sources.shared import shared_dir

from .registry import query, table
from .temporal import V, dated, versions


def _home(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT item_id, sha256(text) AS digest, item_id::VARCHAR AS file FROM benchmark")
def json_files(spark, sf_dir):
    """Every benchmark item as a JSON document of its own over several lines, read back with its file."""
    home, b = _home(spark, "json"), table(spark, sf_dir, "benchmark")
    line = F.to_json(F.struct("item_id", "text"), {"pretty": "true"})
    b.select(F.col("item_id").alias("item"), line.alias("value")).repartition("item").write.partitionBy("item").text(home)
    docs = io.json_documents(spark, f"{home}/*", spark.createDataFrame([], "item_id long, text string").schema)
    return docs.select("item_id", F.sha2("text", 256).alias("digest"), F.regexp_extract("file", "item=([0-9]+)", 1).alias("file"))


@query("SELECT item_id, sha256(substring(text, 1, 120)) AS digest FROM benchmark")
def binary_files(spark, sf_dir):
    """Every benchmark item as a file of bytes, of which the first 120 characters are read by a plug-in."""
    home = _home(spark, "binary")
    table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("value")).repartition("item").write.partitionBy("item").option("lineSep", "\u0003").text(home)
    docs = io.binary_documents(spark, home, lambda b: b.decode().removesuffix("\u0003"), 120).filter(F.col("path").endswith(".txt"))
    return docs.select(F.regexp_extract("path", "item=([0-9]+)", 1).cast("long").alias("item_id"), F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, len(text)::DOUBLE AS size, CASE WHEN trim(text) = '' THEN 0 ELSE 1 END::DOUBLE AS there FROM documents WHERE trim(text) <> ''")
def embedded_index(spark, sf_dir):
    """An index of all documents by a stand-in for a model: what the first run did not have is embedded by the second."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lambda texts: [[float(len(x)), float(bool(x.strip()))] for x in texts]
    empty = models.embed(d.limit(0), "text", model)
    first = models.embed_pending(d.filter("doc_id % 2 = 0"), empty, "doc_id", "text", model)
    index = models.embed_pending(d, first, "doc_id", "text", model)
    return index.select("doc_id", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("there"))


@query("SELECT conv_id, turn, len(text)::BIGINT AS n, text[1] AS first FROM conversations")
def extracted_fields(spark, sf_dir):
    """Typed fields that a stand-in for a model finds in every turn."""
    c = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    got = models.extract(c, "key", "text", lambda x: {"n": len(x), "first": x[:1]}, "n long, first string")
    at = F.split("key", ":")
    return got.select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "n", "first")


@query(f"WITH {V} SELECT family, lane, no, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM w")
def golden_windows(spark, sf_dir):
    """Windows by a lead over the versions, checked against golden ones from each version's least later day."""
    v = versions(spark, sf_dir).groupBy("family", "lane", F.col("effective_at").alias("valid_from")).agg(F.max("no").alias("no"))
    later = v.select("family", "lane", F.col("valid_from").alias("_later"))
    golden = v.join(later, ["family", "lane"], "left").groupBy("family", "lane", "no", "valid_from").agg(F.min(F.when(F.col("_later") > F.col("valid_from"), F.col("_later"))).alias("valid_to"))
    windows = t.version_windows(versions(spark, sf_dir), ["family", "lane"])
    return dated(t.checked_windows(windows, golden, ["family", "lane", "no"]))
