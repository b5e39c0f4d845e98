"""Queries of durable tables: merges that survive a restart, indexes that follow a polled source, groups that wait to be complete."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.operators import memo
from casewright.sources import paged
from casewright.sources.shared import shared_dir
from casewright.sources.versioned import VersionedTable
from casewright.streaming import ingest, polls

from .registry import query, table


def _home(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH one AS (SELECT doc_id AS id, n_chars AS v, 1 AS created FROM documents WHERE doc_id % 2 = 0),
two AS (SELECT coalesce(t.id, s.doc_id) AS id, coalesce(-s.n_chars, t.v) AS v, coalesce(t.created, 2) AS created FROM one t FULL JOIN (FROM documents WHERE doc_id % 3 = 0) s ON t.id = s.doc_id)
SELECT id, CASE WHEN id = (SELECT max(doc_id) FROM documents) THEN 0 ELSE v END AS v, created FROM two WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT max(doc_id), 0, 3 FROM documents HAVING max(doc_id) NOT IN (SELECT id FROM two) AND max(doc_id) NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def durable_merge(spark, sf_dir):
    """Three merges and a delete, each by an object that knows only the path."""
    path, d = _home(spark, "table"), table(spark, sf_dir, "documents")
    VersionedTable.create(spark, path, "id long, v long, created int", ["id"], 16)
    VersionedTable(spark, path).merge(d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("v"), F.lit(1).alias("created")))
    VersionedTable(spark, path).merge(d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), (-F.col("n_chars")).alias("v"), F.lit(2).alias("created")), keep=("created",))
    VersionedTable(spark, path).merge(d.agg(F.max("doc_id").alias("id")).select("id", F.lit(0).cast("long").alias("v"), F.lit(3).alias("created")), keep=("created",))
    VersionedTable(spark, path).replace(table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")))
    return VersionedTable(spark, path).read()


@query("""WITH w AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 4 = 0 AND turn = 0 THEN role || '!' ELSE role END AS second FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN role ELSE second END AS role, CASE WHEN conv_id % 3 > 0 AND (conv_id % 4 = 0 AND min(turn) OVER (PARTITION BY conv_id) = 0 OR conv_id % 5 = 0) THEN 2 ELSE 1 END AS built FROM w""")
def durable_index(spark, sf_dir):
    """Two runs of an incremental index: the second finds a part changed or new, and a third of the cases vanished."""
    path, c = _home(spark, "index"), table(spark, sf_dir, "conversations")
    index = VersionedTable.create(spark, path, "conv_id long, digest string, turn long, role string, built int", ["conv_id"], 16)

    def run(number, rows):
        cases = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("rows"))
        cases = cases.withColumn("digest", F.sha2(F.to_json("rows"), 256))
        index.reindex(cases, "digest", lambda changed: changed.select("conv_id", "digest", F.inline("rows")).withColumn("built", F.lit(number)))

    # conversations divisible by 3 are in the first run only, other multiples of 5 in the second only
    run(1, c.filter("conv_id % 3 = 0 OR conv_id % 5 <> 0"))
    run(2, c.filter("conv_id % 3 <> 0").withColumn("role", F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), F.concat("role", F.lit("!"))).otherwise(F.col("role"))))
    return VersionedTable(spark, path).read().select("conv_id", "turn", "role", "built")


@query("""SELECT o_custkey::VARCHAR AS law, o_orderkey::VARCHAR AS version, CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus || '2' ELSE o_orderstatus END AS digest,
CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS poll, o_totalprice FROM orders WHERE o_orderkey % 5 <> 2 AND o_custkey % 7 <> 3""")
def version_poll_reindex(spark, sf_dir):
    """Three polls of every customer's orders: the second adds and changes some, the third retracts some, and whole customers."""
    home, own = _home(spark, "polls"), polls.stateful_session(spark)
    o = own.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("law"), F.col("o_orderkey").cast("string").alias("version"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    second = F.when(F.col("o_orderkey") % 4 == 1, F.concat("o_orderstatus", F.lit("2"))).otherwise(F.col("o_orderstatus"))
    listed = [(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), (F.lit(True), second), ((F.col("o_orderkey") % 5 != 2) & (F.col("o_custkey") % 7 != 3), second)]
    index = VersionedTable.create(own, f"{home}/index", "law string, version string, digest string, poll long, o_totalprice double", ["law", "version"], 16)
    known = polls.known_table(own, f"{home}/known", 16)
    facts = o.select("law", "version", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    for number, (there, digest) in enumerate(listed):
        pairs = F.filter(F.collect_list(F.when(there, F.struct("version", digest.alias("digest")))), lambda x: x.isNotNull())
        o.groupBy("law").agg(F.map_from_entries(pairs).alias("listed")).select("law", F.lit(number).cast("long").alias("poll"), "listed").write.mode("append").parquet(f"{home}/in")
        arrived = own.readStream.schema("law string, poll long, listed map<string, string>").parquet(f"{home}/in")
        ingest.run_available(arrived, polls.apply_polls(index, known, lambda c: c.join(facts, ["law", "version"]).drop("op")), f"{home}/state")
    return index.read().select("law", "version", "digest", (F.col("poll") + 1).cast("int").alias("poll"), "o_totalprice")


@query("""SELECT conv_id::VARCHAR AS "group", count(DISTINCT turn) AS n, CASE WHEN conv_id % 3 = 0 AND conv_id % 5 <> 0 THEN 'timed out' ELSE 'complete' END AS status FROM conversations GROUP BY conv_id""")
def complete_groups(spark, sf_dir):
    """Conversations whose turns arrive in three files, twice: released once all announced turns are there, at a mark, or by time-out."""
    home, own = _home(spark, "gate"), polls.stateful_session(spark)
    c = own.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("string").alias("group"), "conv_id", "turn")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    none = F.lit(None).cast("long")
    for part in range(3):
        items = c.filter(F.col("turn") % 3 == part).select("group", F.col("turn").cast("string").alias("item"), none.alias("expected"), F.lit(False).alias("done"))
        items = items.unionByName(items)
        if part == 2:
            # a third announces one turn more than there is; a fifth announces nothing but has a mark at its end
            counts = c.groupBy("group", "conv_id").agg(F.count_distinct("turn").alias("n"))
            late = F.when(F.col("conv_id") % 5 != 0, F.col("n") + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0))
            items = items.unionByName(counts.select("group", F.lit(None).cast("string").alias("item"), late.alias("expected"), (F.col("conv_id") % 5 == 0).alias("done")))
        rows = items.withColumn("at", start + F.expr(f"make_interval(0, 0, 0, 0, {part})"))
        if part == 2:
            clock = own.range(1).select(F.lit("clock").alias("group"), F.lit("tick").alias("item"), none.alias("expected"), F.lit(False).alias("done"), (start + F.expr("make_interval(0, 0, 0, 9)")).alias("at"))
        rows.write.mode("append").parquet(f"{home}/in")
        stream = lambda: polls.released(own.readStream.schema(rows.schema).parquet(f"{home}/in").withWatermark("at", "0 seconds"), 86_400)
        ingest.run_available(stream(), ingest.into_table(f"{home}/out", "group"), f"{home}/state")
    clock.write.mode("append").parquet(f"{home}/in")
    ingest.run_available(stream(), ingest.into_table(f"{home}/out", "group"), f"{home}/state")
    return spark.read.schema("group string, n long, status string").option("basePath", f"{home}/out").parquet(f"{home}/out").filter("`group` <> 'clock'").select("group", "n", "status")


@query("""WITH k AS (SELECT doc_id, text, source AS keyword, 1 AS o FROM documents UNION ALL SELECT doc_id, text, lang, 2 FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY doc_id) - 1 AS r FROM k),
w AS (SELECT DISTINCT keyword, o FROM k), n AS (SELECT keyword, row_number() OVER (ORDER BY o, keyword) AS no FROM w),
q AS (SELECT doc_id, keyword, text, r // 100 + 1 + CASE WHEN r >= 100 THEN 2 ELSE 0 END AS page, no, row_number() OVER (PARTITION BY doc_id ORDER BY (r // 100 + CASE WHEN r >= 100 THEN 2 ELSE 0 END) // 4, no) AS first FROM p JOIN n USING (keyword) WHERE r < 900)
SELECT doc_id, keyword, page::INTEGER AS page, sha256(text) AS digest FROM q WHERE first = 1""")
def paged_collection(spark, sf_dir):
    """Documents listed by source and by language in pages of 100: collected in runs of four pages a keyword until a run finds nothing.

    Two empty pages follow each keyword's first one, and three lie before its 901st row, so collecting ends there.
    """
    home, d = _home(spark, "pages"), table(spark, sf_dir, "documents")
    listed = d.select("doc_id", "text", F.explode(F.array(F.struct(F.col("source").alias("keyword"), F.lit(1).alias("o")), F.struct(F.col("lang").alias("keyword"), F.lit(2).alias("o")))).alias("k")).select("doc_id", "text", "k.*")
    r = F.row_number().over(Window.partitionBy("keyword").orderBy("doc_id")) - 1
    page = F.floor(r / 100) + 1 + F.when(r >= 100, 2).otherwise(0) + F.when(r >= 900, 3).otherwise(0)
    listed.select("keyword", page.alias("page"), F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("body")).repartition("keyword", "page").write.partitionBy("keyword", "page").json(f"{home}/landing")
    keywords = [x.keyword for x in listed.select("o", "keyword").distinct().orderBy("o", "keyword").collect()]
    cases = VersionedTable.create(spark, f"{home}/cases", "id string, keyword string, page int, body string", ["id"], 16)
    source = paged.paged_source("landing", paged.page_files(f"{home}/landing"))
    while True:
        rows = paged.collect(spark, source, keywords, cases, f"{home}/log", pages=4)
        if rows.filter("status = 'item'").isEmpty():
            break
    return cases.read().select(F.col("id").cast("long").alias("doc_id"), "keyword", "page", F.col("body").alias("digest"))


@query("""SELECT sha256(text) AS digest, len(text) || ':' || substring(text, 1, 20) AS answer, count(*) AS units, 1 AS calls FROM documents GROUP BY text""")
def memoised_tags(spark, sf_dir):
    """Tags of all documents in two runs over overlapping halves, by a stand-in for a model: each content is asked once."""
    memo_ = memo.memo_table(spark, _home(spark, "memo"), 16)
    # both digests are taken beside the text, so that it need not come along to the answers
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("digest"), F.sha2(F.concat(F.lit("tags\u001f"), "text"), 256).alias("_d"))
    tag = lambda t: f"{len(t)}:{t[:20]}"
    memo.memoised(d.filter("doc_id % 3 <> 0"), "text", "tags", tag, memo_, "first")
    answers = memo.memoised(d, "text", "tags", tag, memo_, "second")
    calls = memo_.read().select(F.col("digest").alias("_d"), "calls")
    return answers.join(calls, "_d").groupBy("digest", "answer", "calls").agg(F.count("*").alias("units")).select("digest", "answer", "units", "calls")
