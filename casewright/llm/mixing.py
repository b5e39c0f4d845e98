"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, n_words, stage

#: Slot i looks up the point i * GOLDEN modulo PERIOD, where GOLDEN / PERIOD is the golden ratio's fraction.
PERIOD, GOLDEN = 1 << 31, 1327217885
CELLS = 1024
CHUNK = 1 << 14
BLOCK = 64


def targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: sid (order by code point, null last), source_size, weight, full (the most it gives), target.

    Targets fill up like water: level * weight, but at most ``most`` times the source's size. With sources in the order
    of the level at which they are full, the level is the largest of (what is left) / (weight that is left).
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1).cast("double"))
    full = F.lit(most) * F.col("source_size")
    order = Window.orderBy(full / F.col("weight"), "sid")
    whole = Window.partitionBy()
    s = s.withColumn("full", full).withColumn(
        "level",
        (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    )
    s = s.withColumn("target", F.least("full", F.max("level").over(whole) * F.col("weight")))
    return s.select("sid", "source", "source_size", "weight", "full", "target")


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two tables: slots of the mix (slot, sid, rank of the slot in its source), and sid, take (words the mix takes of a source).

    The mix has as many slots as blocks fit into the sum of the targets. Slot i goes to the source whose part of the
    cumulative targets holds the golden-ratio point of i, and takes that source's next block; so at any slot where a mix is
    cut, each source has its share but for a few blocks. Ranks come from counts by chunk and source, so no task holds a
    source's slots. A source of which ``most`` times its size is taken gives no more.
    """
    whole, order = Window.partitionBy(), Window.orderBy("sid")
    s = sources.filter("target > 0").withColumn("sum", F.sum("target").over(whole))
    high = F.floor(F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("sum") * PERIOD)
    high = F.when(F.lead("sid").over(order).isNull(), F.lit(PERIOD)).otherwise(high)
    s = s.withColumn("high", high.cast("long"))
    s = stage(s.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0).cast("long"))), "mix-sources")
    n = int(s.agg(F.coalesce(F.ceil(F.max("sum") / block), F.lit(0))).first()[0])
    width = PERIOD // CELLS
    cells = s.filter("low < high").select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") % PERIOD * GOLDEN % PERIOD).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").filter("u >= low and u < high")
    slots = slots.select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = stage(slots.groupBy("sid", "chunk").agg(F.count("*").alias("n")), "mix-counts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "sid").orderBy("slot")) - 1)
    ranked = ranked.join(before.select("sid", "chunk", "before"), ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("r")).alias("rank"))
    taken = counts.groupBy("sid").agg((F.sum("n") * block).alias("due"))
    taken = stage(s.join(taken, "sid").select("sid", F.least("due", F.floor("full")).alias("take")), "mix-take")
    return ranked, taken


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with the words that the mix takes of it and the slots at which it does.

    Each source's documents stand in the order of md5(doc_id), end to end as one stream of words that starts anew after
    its end. The stream is cut into blocks of ``block`` words, and the k-th slot of a source takes its k-th block. As no
    source gives more than ``most`` times its words, no document gives more than ``most`` (2) times its size.

    Null text has size 0; null is a source of its own, the last one; rows that repeat a doc_id are documents of their
    own, and rows without doc_id stand in the order of their text's hash; a source without words takes nothing; an empty
    table gives an empty result. Further columns do not matter. Sources are few beside documents: one row each meets in
    one task. Returns doc_id, size, source_size, target, taken, slot (the first that takes of it; null without), starts
    (slots at which the mix begins the document: none, one or two), source, and the columns ``carry``.
    """
    spark = docs.sparkSession
    seen = F.md5(F.concat(F.lit("?"), F.coalesce("text", F.lit(""))))
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), seen)
    sized = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("uid"), *carry), "mix-sized")
    sources = stage(targets(sized, weights, share, most), "mix-targets")
    own = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("part", F.substring("key", 1, 3))
    parts = own.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("ahead", F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).drop("n")
    line = Window.partitionBy("sid", "part").orderBy("key", "doc_id", "h", "uid").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("inner", F.sum("size").over(line) - F.col("size")).join(parts, ["sid", "part"])
    own = stage(own.select("uid", "doc_id", "source", "sid", "size", "source_size", "target", (F.col("ahead") + F.col("inner")).alias("start"), *carry), "mix-own")
    plan, take = schedule(spark, sources, block)
    passes = own.filter("size > 0").select("uid", "sid", "size", F.explode(F.array(F.col("start"), F.col("start") + F.col("source_size"))).alias("at"))
    passes = passes.join(take, "sid").filter("at < take").withColumn("end", F.least(F.col("at") + F.col("size"), "take"))
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    first = F.col("rank") * block
    hit = pieces.join(plan, ["sid", "rank"]).select("uid", "slot", (F.col("at") >= first).alias("begins"), (F.least("end", first + block) - F.greatest("at", first)).alias("w"))
    taken = hit.groupBy("uid").agg(F.sum("w").alias("taken"), F.min("slot").alias("slot"), F.sort_array(F.collect_list(F.when(F.col("begins"), F.col("slot")))).alias("starts"))
    return own.join(taken, "uid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot", F.coalesce("starts", F.array().cast("array<bigint>")).alias("starts"), "source", *carry)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``documents`` table, and the first slot that takes of a document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "slot")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as the mix begins it (never, once or twice), in the order of the slots that do.

    Rows are told apart by their place in the input, whatever their doc_id.
    """
    rows = keyed(docs, "mix-rows")
    planned = mix(rows.select(*(F.col(f"doc.{c}").alias(c) for c in ("doc_id", "source", "text")), "__file", "__row"), carry=("__file", "__row"))
    starts = planned.select("__file", "__row", F.explode("starts").alias("__slot"))
    return rows.join(starts, ["__file", "__row"]).orderBy("__slot", "__file", "__row").select("doc.*")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), md5('?' || coalesce(text, ''))) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, (CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 2.0::DOUBLE * source_size::DOUBLE AS fully FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(fully) OVER (ORDER BY fully / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY fully / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, least(fully, max(level) OVER () * weight) AS target FROM s3),
s5 AS (SELECT *, sum(target) OVER () AS total, CASE WHEN lead(sid) OVER (ORDER BY sid) IS NULL THEN {PERIOD} ELSE floor(sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * {PERIOD})::BIGINT END AS high FROM s4 WHERE target > 0),
s6 AS (SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low FROM s5),
i AS (SELECT unnest(range(coalesce((SELECT ceil(max(total) / {BLOCK})::BIGINT FROM s5), 0))) AS slot),
p AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM (SELECT slot, slot % {PERIOD} * {GOLDEN} % {PERIOD} AS u FROM i) JOIN s6 ON u >= low AND u < high),
t AS (SELECT sid, least(count(*) * {BLOCK}, floor(any_value(fully))::BIGINT) AS take FROM p JOIN s6 USING (sid) GROUP BY sid),
e AS (SELECT d.doc_id, d.size, s4.sid, s4.source_size, s4.target, coalesce(t.take, 0) AS take,
  (sum(d.size) OVER (PARTITION BY s4.sid ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source LEFT JOIN t ON t.sid = s4.sid)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, take) - start) + greatest(0, least(start + size, take - source_size) - start))::BIGINT AS taken, p.slot::BIGINT AS slot
FROM e LEFT JOIN p ON p.sid = e.sid AND p.rank = e.start // {BLOCK} AND e.size > 0 AND e.start < e.take
"""
