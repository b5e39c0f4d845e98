"""Queries of statutes: references between laws, texts of chapters and articles, annexes, case citations by issue."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.operators import merge as m
from casewright.operators import statute as st

from .registry import query, table
from .reports import _laws

_ARTICLES = "SELECT DISTINCT o.* FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey"
_UNITS = f"""u AS (SELECT o_custkey AS law_id, o_orderkey AS no, 'ARTICLE' AS level, '00000000' AS p, '00000000' AS i, o_orderstatus || chr(10) || o_orderpriority AS text FROM ({_ARTICLES})
UNION ALL SELECT o_custkey, o_orderkey, 'PARAGRAPH', lpad(l_linenumber::VARCHAR, 8, '0'), '00000000', 'p' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT o_custkey, o_orderkey, 'ITEM', lpad(l_linenumber::VARCHAR, 8, '0'), lpad(l_returnflag, 8, '0'), l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 1)"""


@query(f"""WITH {_UNITS}, a AS (SELECT law_id, no, string_agg(text, chr(10) ORDER BY p, i, text) AS body FROM u GROUP BY 1, 2)
SELECT a.law_id, o_orderpriority AS chapter_id, sha256('[CHAPTER] ' || o_orderpriority || chr(10) || string_agg(body, chr(10) ORDER BY no)) AS digest FROM a JOIN orders ON o_orderkey = no GROUP BY 1, o_orderpriority""")
def chapter_texts(spark, sf_dir):
    arts = st.articles(_laws(spark, sf_dir))
    return st.chapter_texts(arts, st.units(arts)).select("law_id", "chapter_id", F.sha2("text", 256).alias("digest"))


_HEAD = "'제' || (o_orderkey % 40 + 1) || '조' || CASE o_orderkey % 3 WHEN 0 THEN '의2(' WHEN 1 THEN '(' ELSE ' 삭제 ' END || o_orderkey"


@query(f"""SELECT o_custkey AS law_id, '12' AS asked, min_by({_HEAD}, (o_orderkey % 3, o_orderkey)) AS text FROM orders WHERE o_orderkey % 40 = 11 AND o_orderkey % 3 > 0 GROUP BY 1
UNION ALL SELECT o_custkey, '제12조의2', min_by({_HEAD}, o_orderkey) FROM orders WHERE o_orderkey % 40 = 11 AND o_orderkey % 3 = 0 GROUP BY 1""")
def article_by_number(spark, sf_dir):
    # some articles have a sub-number, which only their heading tells, and some a heading without a bracket
    end = F.when(F.col("o_orderkey") % 3 == 0, "의2(").when(F.col("o_orderkey") % 3 == 1, "(").otherwise(" 삭제 ")
    heading = F.concat(F.lit("제"), F.col("o_orderkey") % 40 + 1, F.lit("조"), end, "o_orderkey")
    units = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law_id"), F.concat(F.lit("ART_"), F.col("o_orderkey") % 40 + 1).alias("article_id"), F.lpad("o_orderkey", 12, "0").alias("level"), heading.alias("text"))
    found = [st.ranked_article(units, n).select("law_id", F.lit(n).alias("asked"), "text") for n in ("12", "제12조의2")]
    return found[0].unionByName(found[1])


@query("""SELECT l_orderkey AS version_key, 'ANNEX_' || (l_suppkey % 3 + 1) AS base, count(*) AS parts, max_by(l_returnflag, (n, l_returnflag)) AS role,
min_by(d, (l_linenumber, d)) FILTER (d <> '') AS description, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS articles
FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'd' || l_partkey END AS d, count(*) OVER (PARTITION BY l_orderkey, l_suppkey % 3, l_returnflag) AS n FROM lineitem) GROUP BY l_orderkey, l_suppkey % 3""")
def annex_merge(spark, sf_dir):
    part = F.concat(F.lit("ANNEX_"), F.col("l_suppkey") % 3 + 1, F.lit("_"), "l_linenumber")
    d = F.when(F.col("l_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit("d"), "l_partkey"))
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_key"), part.alias("annex_id"), F.col("l_returnflag").alias("role"), d.alias("description"), F.array(F.col("l_partkey").cast("string")).alias("articles"))
    return st.number_of_annexes(a).withColumn("articles", F.array_join("articles", ","))


_CROSS = ", ".join(f"('{a}', '{b}')" for a, bs in x.CROSS_LAW.items() for b in bs)


@query(f"""WITH e(law_name, linked) AS (VALUES {_CROSS}), names AS (SELECT list(DISTINCT law_name ORDER BY law_name) AS l FROM e),
v AS (SELECT ['국세기본법', '소득세법', '법인세법'][(o_orderkey % 3 + 1)::INT] AS law, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS version_key FROM orders GROUP BY 1)
SELECT c_custkey, e.law_name, e.linked, v.version_key FROM (SELECT c_custkey, l[(c_custkey % len(l) + 1)::INT] AS law FROM customer, names) c JOIN e ON e.law_name = c.law LEFT JOIN v ON v.law = e.linked""")
def cross_law_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    law = F.when(F.col("o_orderkey") % 3 == 0, "국세기본법").when(F.col("o_orderkey") % 3 == 1, "소득세법").otherwise("법인세법")
    versions = o.select(law.alias("law_name"), F.col("o_orderdate").alias("effective_at"), F.col("o_orderkey").alias("version_key"))
    names = F.array(*map(F.lit, sorted(x.CROSS_LAW)))
    changed = table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % len(x.CROSS_LAW)).cast("int")).alias("law_name"))
    impact = st.cross_law_impact(changed.select("law_name").distinct(), versions)
    return changed.join(impact, "law_name").select("c_custkey", "law_name", "linked", "version_key")


@query("""SELECT '법' || chr((97 + l_suppkey % 20)::INT) || CASE WHEN l_partkey % 2 = 0 THEN ' 시행령' ELSE '' END AS law_name, count(*) AS n FROM lineitem WHERE l_linenumber <> 3 AND NOT (l_suppkey % 20 < 5 AND l_partkey % 2 = 1) GROUP BY 1""")
def external_targets(spark, sf_dir):
    name = F.concat(F.lit("법"), F.char((97 + F.col("l_suppkey") % 20).cast("int")))
    cite = F.concat(name, F.when(F.col("l_partkey") % 2 == 0, " 시행령").otherwise(""), F.when(F.col("l_linenumber") == 4, "에 따른 ").otherwise(" "), F.lit("제"), "l_partkey", F.lit("조"))
    cites = table(spark, sf_dir, "lineitem").withColumn("target", F.when(F.col("l_linenumber") == 3, F.concat(F.lit("제"), "l_partkey", F.lit("조"))).otherwise(cite))
    owned = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(F.concat(F.lit("법"), F.char((97 + F.col("n_nationkey")).cast("int"))).alias("law_name"))
    return st.external_targets(cites, owned)


@query("""SELECT o_orderkey AS target, o_custkey AS law_id, coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y%m%d') END, strftime(o_orderdate, '%Y%m%d')) AS effective,
c.c_name AS law_name FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c_custkey % 2 = 0 WHERE o_orderstatus <> 'F'""")
def unresolved_targets(spark, sf_dir):
    key = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("version_key", key)
    targets = o.select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("law_id"), "version_key", F.when(F.col("o_orderstatus") == "F", "known").alias("resolved_version_key"))
    versions = o.filter("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("law_id"), "version_key", F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyyMMdd").alias("effective"))
    laws = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("law_id"), F.col("c_name").alias("law_name"))
    return st.unresolved(targets, versions, laws).select("target", "law_id", "effective", "law_name")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, max_by(l_partkey, (l_linenumber, l_partkey)) AS cited FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT DISTINCT l.l_orderkey, l.l_returnflag AS issue, coalesce(c.cited, -1) AS cited FROM lineitem l LEFT JOIN c USING (l_orderkey, l_returnflag)""")
def attach_citations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("issue"), "l_linenumber", F.col("l_partkey").alias("cited"))
    found = m.last_wins(lines.filter("issue <> 'N'"), ["l_orderkey", "issue"], ["l_linenumber", "cited"])
    return m.enrich(lines.select("l_orderkey", "issue").distinct(), found, ["l_orderkey", "issue"], {"cited": -1})


@query("""SELECT conv_id, sha256(list_reduce(list_prepend('', list(t ORDER BY turn)), lambda a, b: CASE WHEN a = '' THEN b WHEN contains(a, b) THEN a ELSE a || chr(10) || b END)) AS digest
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN role ELSE role || ' ' || text END AS t FROM conversations) GROUP BY 1""")
def narrative_append(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.col("role")).otherwise(F.concat_ws(" ", "role", "text")).alias("t"))
    return m.append_text(c, ["conv_id"], ["turn"], "t").select("conv_id", F.sha2("t", 256).alias("digest"))


@query("""SELECT doc_id, lang, 'old' AS built FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'q' || quality, 'new' FROM labels""")
def overwrite_rows(spark, sf_dir):
    old = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", "lang", F.lit("old").alias("built"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("lang"), F.lit("new").alias("built"))
    return m.overwrite_by_key(old, new, ["doc_id"])
