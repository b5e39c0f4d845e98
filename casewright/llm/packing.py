"""Packing: length buckets with the least padding, and token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, n_words, stage

def best_bounds(lengths, counts, totals, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that together pad the least.

    lengths: all lengths, ascending; counts and totals: documents and words of each. cost(i, j) is what lengths i..j pad
    if filled up to lengths[j]; the best first length of a last bucket never moves left as j grows, so each layer of the
    dynamic programme is solved by halving, in time and memory of about the number of lengths.
    """
    lengths, c, t = np.asarray(lengths, np.float64), np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64))), np.concatenate(([0.0], np.cumsum(totals, dtype=np.float64)))
    n = len(lengths)
    best = lengths * c[1:] - t[1:]
    choice = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, pick, todo = np.empty(n), np.zeros(n, np.int64), [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(j, b) + 1)
            cost = np.where(i > 0, best[i - 1], 0.0) + lengths[j] * (c[j + 1] - c[i]) - (t[j + 1] - t[i])
            k = int(np.argmin(cost))
            new[j], pick[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, i[k]), (j + 1, hi, i[k], b)]
        best = new
        choice.append(pick)
    bounds, j = [], n - 1
    for pick in reversed(choice):
        if j < 0:
            break
        bounds.append(int(lengths[j]))
        j = int(pick[j]) - 1
    return sorted(set(bounds))


def pack(docs: DataFrame, buckets: int = 8, budget: int = 16_384, spread: int = 50_000, in_order: bool = False) -> DataFrame:
    """Every document: doc_id, n_tokens, bucket, bucket_len, batch_id, slot; ``in_order`` also text, file, row (its place in docs).

    A bucket's documents fill up to bucket_len tokens, and a batch holds as many as fit into ``budget`` padded tokens (a
    longer document makes a batch alone). Documents of a bucket are dealt by a hash into lots of about ``spread``, so no
    task holds a bucket; batches form within lots, in the order of the hash, and only the last of a lot may be part full.
    ``in_order`` makes lots of runs of rows instead, at most ``spread`` rows of one file, so batches keep the order of docs.
    Tokens are words. The histogram has every length on its own, so the padding is the least there is; it grows with the
    number of different lengths, not of documents. Empty and null texts have no tokens and share the shortest bucket;
    repeated rows, and rows without doc_id, are packed each, dealt by their place; an empty table packs into
    nothing; further columns do not matter, whatever their names.
    """
    spark = docs.sparkSession
    # rows without doc_id, or that repeat one, would share a hash: a row's number in its file tells them apart
    rows = keyed(docs, "pack-docs")
    named = rows.select(F.col("doc.doc_id").alias("doc_id"), n_words(F.col("doc.text")).alias("n_tokens"), F.xxhash64("doc.doc_id", "__row").alias("h"), F.col("doc.text").alias("text"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    sized = stage(named.select("doc_id", "n_tokens", "h"), "pack-sized")
    extra = ["text", "file", "row"] if in_order else []
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    if not histogram:
        return named.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.col("n_tokens").alias("bucket_len"), F.lit("").alias("batch_id"), F.lit(0).alias("slot"), *extra)
    bounds = best_bounds([r["n_tokens"] for r in histogram], [r["n"] for r in histogram], [r["n"] * r["n_tokens"] for r in histogram], buckets)
    bucket, low = None, -1
    for k, b in enumerate(bounds):
        lots = max(1, -(-sum(r["n"] for r in histogram if low < r["n_tokens"] <= b) // spread))
        one = F.struct(F.lit(k).alias("bucket"), F.lit(b).cast("long").alias("bucket_len"), F.lit(lots).cast("long").alias("lots"))
        bucket = F.when(F.col("n_tokens") <= b, one) if bucket is None else bucket.when(F.col("n_tokens") <= b, one)
        low = b
    d = (named if in_order else sized).withColumn("b", bucket).select("doc_id", "n_tokens", "h", *extra, "b.*")
    if in_order:
        # files are few beside rows: a number for each, in the order of their names
        files = named.select("file").distinct().withColumn("no", F.row_number().over(Window.orderBy("file")) - 1)
        d = d.join(files, "file").withColumn("lot", F.concat_ws(".", "no", F.floor(F.col("row") / spread))).drop("no")
        order = ["row"]
    else:
        d = d.withColumn("lot", F.pmod("h", F.col("lots")))
        order = ["h", "doc_id", "n_tokens"]
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))))
    place = F.row_number().over(Window.partitionBy("bucket", "lot").orderBy(*order)) - 1
    d = d.withColumn("place", place).withColumn("fit", fit)
    return d.select("doc_id", "n_tokens", "bucket", "bucket_len", F.concat_ws("-", "bucket", "lot", F.floor(F.col("place") / F.col("fit"))).alias("batch_id"), (F.col("place") % F.col("fit")).cast("int").alias("slot"), *extra)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of what the mix left, in the mix's order, each document with its text and its place in the mix's table."""
    return pack(docs, in_order=True)
