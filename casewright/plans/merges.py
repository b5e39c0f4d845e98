"""Merge, dedup and upsert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import merge as m

from .registry import query, table


@query("""SELECT o.o_orderkey, o.o_custkey, coalesce(l.n, 0) AS refs, coalesce(l.top, 'none') AS top_flag FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_returnflag) AS top FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""")
def enrich_left_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("refs"), F.max("l_returnflag").alias("top_flag"))
    return m.enrich(o, tags, ["o_orderkey"], {"refs": 0, "top_flag": "none"})


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
f AS (SELECT conv_id, w, min(turn * 10000000 + i) AS p FROM w GROUP BY ALL) SELECT conv_id, string_agg(w, '|' ORDER BY p) AS words FROM f GROUP BY 1""")
def group_merge_lists(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    return m.merge_lists(c, ["conv_id"], ["turn"], ["words"]).withColumn("words", F.array_join("words", "|"))


@query("SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def outline_first_wins(spark, sf_dir):
    return m.first_wins(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", "text")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY sha256(text)")
def dedup_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query("""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha256(text) END AS digest, 'old' AS built FROM documents WHERE doc_id % 3 <> 0),
c AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(c.doc_id, i.doc_id) AS doc_id, CASE WHEN c.doc_id IS NOT NULL AND c.digest IS DISTINCT FROM i.digest THEN c.digest ELSE i.digest END AS digest,
CASE WHEN c.doc_id IS NOT NULL AND c.digest IS DISTINCT FROM i.digest THEN 'new' ELSE 'old' END AS built FROM i FULL JOIN c ON i.doc_id = c.doc_id""")
def digest_incremental(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    index = d.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("digest")).alias("digest"), F.lit("old").alias("built"))
    return m.incremental(index, d.filter("doc_id % 2 = 0"), "doc_id", "digest", lambda c: c.withColumn("built", F.lit("new")))


@query("""SELECT coalesce(t.id, s.id) AS id, coalesce(s.v, t.v) AS v, coalesce(t.created, s.created) AS created FROM (SELECT doc_id AS id, n_chars AS v, 1 AS created FROM documents WHERE doc_id % 2 = 0) t
FULL JOIN (SELECT doc_id AS id, -n_chars AS v, 2 AS created FROM documents WHERE doc_id % 3 = 0) s ON t.id = s.id""")
def upsert_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    target = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("v"), F.lit(1).alias("created"))
    source = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), (-F.col("n_chars")).alias("v"), F.lit(2).alias("created"))
    return m.upsert(target, source, ["id"], keep=["created"])


_ST = """st AS (SELECT doc_id AS case_id, 'raw' AS stage FROM documents UNION ALL SELECT doc_id, 'logic' FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'narrative' FROM labels WHERE toxic = 0)"""


def _stages(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    one = lambda df, s: df.select(F.col("doc_id").alias("case_id"), F.lit(s).alias("stage"))
    return one(d, "raw").unionByName(one(lab.filter("quality = 1"), "logic")).unionByName(one(lab.filter("toxic = 0"), "narrative"))


@query(f"WITH {_ST} SELECT case_id, stage FROM st QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY CASE stage WHEN 'narrative' THEN 1 WHEN 'logic' THEN 2 ELSE 3 END) = 1")
def first_available_stage(spark, sf_dir):
    return m.first_available(_stages(spark, sf_dir), "case_id", "stage", ["narrative", "logic", "raw"])


@query(f"WITH {_ST}, done AS (SELECT case_id FROM st GROUP BY 1 HAVING count(DISTINCT stage) = 3) SELECT case_id, stage FROM st WHERE stage = 'raw' OR case_id IN (FROM done)")
def clear_partial(spark, sf_dir):
    return m.drop_incomplete(_stages(spark, sf_dir), "case_id", "stage", ["raw"], ["raw", "logic", "narrative"])


@query(f"WITH {_ST} SELECT case_id FROM st GROUP BY 1 HAVING count(DISTINCT stage) = 3")
def complete_case_scan(spark, sf_dir):
    return m.complete_cases(_stages(spark, sf_dir), "case_id", "stage", ["raw", "logic", "narrative"])


@query("""WITH p AS (SELECT conv_id, turn, text, list(text) OVER (PARTITION BY conv_id ORDER BY turn) AS l FROM conversations) SELECT conv_id, turn, l[2] AS second FROM p WHERE turn >= 1""", name="positional_join")
def positional_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lists = c.groupBy("conv_id").agg(m.ordered_list(["turn"], "text").alias("all"))
    refs = c.filter("turn >= 1").select("conv_id", "turn", F.lit(2).alias("pos"))
    return m.positional(lists, "conv_id", "all", refs, "pos", "second").select("conv_id", "turn", "second")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return m.delete_keys(d, table(spark, sf_dir, "labels").filter("toxic = 1"), ["doc_id"])


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'flagged' ELSE d.lang END AS lang, CASE WHEN d.n_chars > 3000 THEN NULL ELSE d.source END AS source FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id""")
def batch_update_reset(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    changes = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("flagged").alias("lang"))
    return m.reset(m.update_where(d, changes, ["doc_id"], ["lang"]), F.col("n_chars") > 3000, ["source"]).drop("n_chars")
