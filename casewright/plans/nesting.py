"""Queries of nested laws changed in place, of edges and lookups over several tables, and of texts reduced to one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.operators import nested, segment, statute
from casewright.sources.shared import shared_dir
from casewright.sources.versioned import VersionedTable

from .registry import query, table
from .reports import _laws


@query("""WITH l AS (SELECT l_orderkey, l_linenumber::VARCHAR AS p, l_linenumber % 2 AS odd, l_returnflag AS i, l_linestatus AS ls, l_partkey FROM lineitem),
n AS (SELECT l_orderkey, p, min_by(ls, (ls, 'p' || l_partkey)) AS roles, min_by('p' || l_partkey, (ls, 'p' || l_partkey)) AS label FROM l WHERE i = 'R' GROUP BY 1, 2),
c AS (SELECT l_orderkey, p, i, min(l_partkey::VARCHAR) AS target FROM l WHERE odd = 1 GROUP BY 1, 2, 3)
SELECT o_custkey AS law_id, 'ART_' || o_orderkey AS article_id, 'ARTICLE' AS level, '' AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'root' ELSE '' END AS roles, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS short_label, '' AS targets FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l)
UNION ALL SELECT o_custkey, 'ART_' || o_orderkey, 'PARAGRAPH', p, coalesce(n.roles, ''), n.label, '' FROM orders JOIN l ON o_orderkey = l_orderkey LEFT JOIN n USING (l_orderkey, p)
UNION ALL SELECT o_custkey, 'ART_' || o_orderkey, 'ITEM', p || '|' || i, '', NULL, target FROM orders JOIN l ON o_orderkey = l_orderkey JOIN c USING (l_orderkey, p, i) WHERE odd = 1""")
def norm_units_in_place(spark, sf_dir):
    """Tags of articles, paragraphs and items set inside the nested laws, in chapters and in sections."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    art = F.concat(F.lit("ART_"), "o_orderkey").alias("article_id")
    rows = o.join(li, "o_orderkey").select(F.col("o_custkey").alias("law_id"), art, F.col("l_linenumber").cast("string").alias("p"), "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey")
    norms = o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("law_id"), art, F.lit("ARTICLE").alias("level"), F.lit("").alias("ref"), F.array(F.lit("root")).alias("roles"), F.col("o_orderpriority").alias("short_label"))
    norms = norms.unionByName(rows.filter("l_returnflag = 'R'").select("law_id", "article_id", F.lit("PARAGRAPH").alias("level"), F.col("p").alias("ref"), F.array("l_linestatus").alias("roles"), F.concat(F.lit("p"), "l_partkey").alias("short_label")))
    target = F.array(F.struct(F.lit("cites").alias("type"), F.col("l_partkey").cast("string").alias("target"), F.lit(None).cast("string").alias("note")))
    refs = rows.filter("l_linenumber % 2 = 1").select("law_id", "article_id", F.lit("ITEM").alias("level"), F.concat_ws("|", "p", "l_returnflag").alias("ref"), target.alias("cross_refs"))
    laws = nested.with_norm_units(_laws(spark, sf_dir), norms, refs)
    c = laws.select("law_id", F.explode("chapters").alias("c"))
    arts = c.select("law_id", F.explode(F.concat("c.articles", F.flatten("c.sections.articles"))).alias("a"))
    u = arts.select("law_id", F.col("a.id").alias("article_id"), F.inline("a.norm_units"))
    return u.select("law_id", "article_id", "level", "ref", F.array_join("roles", ",").alias("roles"), "short_label", F.array_join("cross_refs.target", ",").alias("targets"))


@query("""WITH a AS (SELECT *, CASE WHEN o_orderkey % 10 > 0 THEN strftime(o_orderdate, '%Y%m%d') END AS d FROM orders)
SELECT o_custkey AS law_id, string_agg(coalesce(d, '-') || ':' || o_orderkey, ',' ORDER BY d NULLS FIRST, o_orderkey::VARCHAR) AS addenda, first(o_orderstatus ORDER BY d NULLS FIRST, o_orderkey::VARCHAR) AS law_type FROM a GROUP BY 1""")
def addenda_by_date(spark, sf_dir):
    date = F.when(F.col("o_orderkey") % 10 > 0, F.date_format("o_orderdate", "yyyyMMdd"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law_id"), date.alias("addenda_date"), F.col("o_orderstatus").alias("law_type"), F.col("o_orderkey").cast("string").alias("content"))
    m = nested.merge_addenda(o, ["law_id"])
    return m.select("law_id", F.array_join(F.transform("addenda", lambda a: F.concat(F.coalesce(a["date"], F.lit("-")), F.lit(":"), a["content"])), ",").alias("addenda"), "law_type")


@query("""WITH c AS (SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'LAW' WHEN 1 THEN 'DECREE' ELSE 'RULE' END AS scope, (l_partkey % 50)::VARCHAR AS version_key, l_suppkey % 7 AS id FROM lineitem WHERE l_partkey % 11 > 0),
i AS (SELECT DISTINCT o_custkey % 50 AS a, o_orderkey % 50 AS b, o_orderkey % 7 AS id FROM orders)
SELECT 'LAW_' || a || '__DECREE_' || b || CASE WHEN b % 4 = 0 THEN '' ELSE '__RULE_' || a END AS set_key, 'CH_' || i.id AS chapter_id, scope, version_key FROM i JOIN c ON c.id = i.id
 AND (scope = 'LAW' AND version_key = a::VARCHAR OR scope = 'DECREE' AND version_key = b::VARCHAR OR scope = 'RULE' AND version_key = a::VARCHAR AND b % 4 > 0)""")
def source_chapter_edges(spark, sf_dir):
    scope = F.element_at(F.array(F.lit("LAW"), F.lit("DECREE"), F.lit("RULE")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    chapters = table(spark, sf_dir, "lineitem").filter("l_partkey % 11 > 0").select(scope.alias("scope"), (F.col("l_partkey") % 50).cast("string").alias("version_key"), F.concat(F.lit("CH_"), F.col("l_suppkey") % 7).alias("id"))
    a, b = F.col("o_custkey") % 50, F.col("o_orderkey") % 50
    key = F.concat(F.lit("LAW_"), a, F.lit("__DECREE_"), b, F.when(b % 4 == 0, "").otherwise(F.concat(F.lit("__RULE_"), a)))
    integrated = table(spark, sf_dir, "orders").select(key.alias("set_key"), F.concat(F.lit("CH_"), F.col("o_orderkey") % 7).alias("chapter_id"))
    return nested.source_chapters(integrated, chapters)


@query("""SELECT o_orderkey, 'customer/' || o_custkey AS law_path, 'part/' || (o_orderkey % (SELECT count(*) FROM part)) AS decree_path, 'order/' || o_orderkey AS rule_path FROM orders""")
def snapshot_file_paths(spark, sf_dir):
    """Every order's three parts, looked up in one index; a missing one would fail the query by name."""
    o, part, c = (table(spark, sf_dir, t) for t in ("orders", "part", "customer"))
    n = part.count()
    entry = lambda df, scope, folder, col: df.select(F.concat(F.lit(f"{scope}:"), F.col(col)).alias("key"), F.concat(F.lit(f"{folder}/"), F.col(col)).alias("path"))
    index = entry(c, "LAW", "customer", "c_custkey").unionByName(entry(part, "DECREE", "part", "p_partkey")).unionByName(entry(o, "RULE", "order", "o_orderkey"))
    s = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("law"), (F.col("o_orderkey") % n).cast("string").alias("decree"), F.col("o_orderkey").cast("string").alias("rule"))
    return nested.snapshot_paths(s, index, "o_orderkey", {"LAW": "law", "DECREE": "decree", "RULE": "rule"})


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS run, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS entry FROM documents""")
def version_store(spark, sf_dir):
    """A store of versions that is added to, never overwritten: the second run brings other entries for what is there."""
    path, d = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    VersionedTable.create(spark, path, "doc_id long, run string, entry string", ["doc_id"], 16)
    nested.save_once(d.filter("doc_id % 2 = 0").select("doc_id", F.lit("first").alias("run"), F.col("lang").alias("entry")), VersionedTable(spark, path))
    nested.save_once(d.select("doc_id", F.lit("second").alias("run"), F.col("source").alias("entry")), VersionedTable(spark, path))
    return VersionedTable(spark, path).read()


@query("SELECT l_orderkey, sum(l_partkey)::VARCHAR AS total FROM lineitem GROUP BY 1")
def reduced_texts(spark, sf_dir):
    """Numbers as texts, packed three or so at a time and shortened to their sum, level by level until one is left."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("total"))
    add = lambda t: F.aggregate(F.split(t, "\n"), F.lit(0).cast("long"), lambda a, n: a + n.cast("long")).cast("string")
    return segment.reduce_in_one_job(li, "l_orderkey", "l_linenumber", "total", lambda t: F.length(t).cast("long"), 18, add, block=4)


@query("""WITH a AS (SELECT DISTINCT o.o_custkey AS law_id, o.o_orderkey, o.o_orderstatus, o.o_orderpriority FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey),
q AS (SELECT DISTINCT o_custkey AS law_id, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 10000000 ELSE 0 END AS no FROM orders)
SELECT q.law_id, 'ART_' || no AS article_id, o_orderpriority AS chapter_id, o_orderstatus AS title, (SELECT count(*) FROM lineitem WHERE l_orderkey = a.o_orderkey) AS paragraphs FROM q LEFT JOIN a ON a.law_id = q.law_id AND a.o_orderkey = q.no""")
def articles_by_id(spark, sf_dir):
    """Every order asked for as an article of its customer's law, in chapters and in sections; a fifth is asked for under a number that there is not."""
    o = table(spark, sf_dir, "orders")
    no = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 5 == 0, 10_000_000).otherwise(0)
    asks = o.select(F.col("o_custkey").alias("law_id"), F.concat(F.lit("ART_"), no).alias("article_id"))
    f = statute.find_articles(_laws(spark, sf_dir), asks)
    return f.select("law_id", "article_id", "chapter_id", F.col("article.title").alias("title"), F.when(F.col("article").isNotNull(), F.size("article.paragraphs")).otherwise(0).cast("long").alias("paragraphs"))


@query("SELECT DISTINCT o_custkey AS law_id, o_orderpriority AS chapter_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def chapters_of_laws(spark, sf_dir):
    return statute.chapter_list(_laws(spark, sf_dir))


@query("""WITH l AS (SELECT doc_id, lang, source, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, substring('[fact_summary] ' || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '[court_reasoning] ' || text || chr(10) ELSE '' END || '[defendant_arguments] ' || lang, 1, 4000) AS narrative,
substring(CASE WHEN doc_id % 3 > 0 THEN '[개요] ' || substring(text, 1, 500) || chr(10) ELSE '' END || array_to_string(list_transform(ls[1:3], lambda x: '[쟁점] ' || substring(x, 1, 300)), chr(10)) || chr(10) || '[논거] ' || source || ': ' || substring(text, 1, 200), 1, 4000) AS logic,
substring(array_to_string(list_filter(list_transform(ls[1:20], lambda x: substring(trim(x), 1, 200)), lambda x: x <> ''), chr(10)), 1, 4000) AS raw,
source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || lang END AS chain FROM l""")
def case_text_variants(spark, sf_dir):
    """The three texts that a case may be embedded by, each with its parts, limits and labels, and an argument's chain."""
    d = table(spark, sf_dir, "documents").withColumn("ls", F.split("text", "\n"))
    parts = {"fact_summary": F.col("source"), "court_reasoning": F.when(F.col("doc_id") % 2 == 0, F.col("text")), "conclusion": F.lit(""), "defendant_arguments": F.col("lang")}
    chains = F.array(F.struct(F.lit("").alias("issue"), F.col("lang").alias("premise")), F.struct(F.col("source").alias("issue"), F.col("text").alias("premise")))
    return d.select("doc_id", x.narrative_text(lambda n: parts.get(n, F.lit(None).cast("string"))).alias("narrative"), x.issue_logic_text(F.when(F.col("doc_id") % 3 > 0, F.col("text")), F.col("ls"), chains).alias("logic"),
                    x.raw_text(F.col("ls")).alias("raw"), x.chain_text(F.col("source"), F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))).alias("chain"))
