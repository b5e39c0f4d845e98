"""Streaming queries, run to the end of what is there, and the statute queries that need no citations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright.sources.shared import shared_dir
from casewright.streaming import ingest

from .registry import query, table


def _home(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def stream_ingest(spark, sf_dir):
    home, events = _home(spark), table(spark, sf_dir, "events")
    # the same events arrive twice, in several files
    events.unionByName(events).repartition(4, "user_id").write.parquet(f"{home}/in")
    rows = ingest.new_rows(spark, f"{home}/in", events.schema, "event_id", files=2)
    ingest.run_available(rows, ingest.into_table(f"{home}/out", "event_id"), f"{home}/state")
    out = ingest.read_table(spark, f"{home}/out", events.schema, "event_id")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    # the earlier half comes first, then the later one; the second run goes on from the first one's state
    home = _home(spark)
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ends = e.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(ends[0] + (ends[1] - ends[0]) / 2) if ends[0] else F.lit(None).cast("timestamp")
    for part in (e.filter(F.col("ts") < middle), e.filter(F.col("ts") >= middle)):
        part.write.mode("append").parquet(f"{home}/in")
        counts = ingest.windowed_counts(spark.readStream.schema(e.schema).parquet(f"{home}/in"), "ts", "event_type")
        ingest.run_available(counts, ingest.into_table(f"{home}/out", "start"), f"{home}/state", mode="update")
    out = ingest.latest_rows(spark, f"{home}/out", counts.schema, ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
