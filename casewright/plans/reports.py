"""Queries of nested reports and statutes. A customer stands for a law, its orders for articles, their lines for paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import merge as m
from casewright.operators import reports as r
from casewright.operators import statute as st
from casewright.operators import temporal as t

from .registry import query, table


def _laws(spark, sf_dir):
    """One nested row a customer: priorities are chapters, and open or partial orders stand in sections."""
    none = F.array().cast("array<struct<subitem_no:string,text:string>>")
    item = F.struct(F.col("l_returnflag").alias("item_no"), F.col("l_linestatus").alias("text"), none.alias("subitems"))
    para = F.struct(F.col("l_linenumber").cast("string").alias("para_no"), F.concat(F.lit("p"), "l_partkey").alias("text"), F.when(F.col("l_linenumber") % 2 == 1, F.array(item)).otherwise(F.array().cast("array<struct<item_no:string,text:string,subitems:array<struct<subitem_no:string,text:string>>>>")).alias("items"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(para)).alias("paragraphs"))
    # a customer's orders come together once, for sections, chapters and laws
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey").repartition("o_custkey")
    art = F.struct(F.concat(F.lit("ART_"), "o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("raw_text"), F.when(F.col("o_orderkey") % 7 == 0, "own").alias("domain"), "paragraphs")
    s = o.groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(F.collect_list(art).alias("a"))
    empty = F.array().cast(s.schema["a"].dataType)
    section = F.struct(F.col("o_orderstatus").alias("id"), F.when(F.col("o_orderstatus") == "P", "partial").alias("domain"), F.col("a").alias("articles"))
    direct = F.col("o_orderstatus") == "F"
    c = s.groupBy("o_custkey", "o_orderpriority").agg(F.collect_list(F.when(~direct, section)).alias("sections"), F.coalesce(F.first(F.when(direct, F.col("a")), True), empty).alias("articles"))
    chapter = F.struct(F.col("o_orderpriority").alias("id"), F.when(F.col("o_orderpriority").startswith("1"), "urgent").alias("domain"), "articles", "sections")
    return c.groupBy(F.col("o_custkey").alias("law_id")).agg(F.sort_array(F.collect_list(chapter)).alias("chapters"))


_ARTICLES = "SELECT DISTINCT o.* FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey"


@query(f"""SELECT o_custkey AS law_id, 'ART_' || o_orderkey AS article_id, 'ARTICLE' AS level, NULL AS para_no, NULL AS item_no, o_orderstatus || chr(10) || o_orderpriority AS text FROM ({_ARTICLES})
UNION ALL SELECT o_custkey, 'ART_' || o_orderkey, 'PARAGRAPH', l_linenumber::VARCHAR, NULL, 'p' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT o_custkey, 'ART_' || o_orderkey, 'ITEM', l_linenumber::VARCHAR, l_returnflag, l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 1""")
def flatten_units(spark, sf_dir):
    return st.units(st.articles(_laws(spark, sf_dir))).select("law_id", "article_id", "level", "para_no", "item_no", "text")


@query(f"""SELECT o_custkey AS law_id, 'ART_' || o_orderkey AS article_id, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN 'own' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END) AS domain FROM ({_ARTICLES})""")
def article_domains(spark, sf_dir):
    return st.articles(_laws(spark, sf_dir)).select("law_id", "article_id", "domain")


@query("""SELECT o_orderkey AS id, level, text FROM (SELECT o.o_orderkey, CASE WHEN l.l_linenumber IS NULL THEN 'ARTICLE' WHEN l.l_linenumber % 2 = 1 THEN 'ITEM' ELSE 'PARAGRAPH' END AS level,
CASE WHEN l.l_linenumber IS NULL THEN o.o_orderstatus || chr(10) || o.o_orderpriority WHEN l.l_linenumber % 2 = 1 THEN l.l_linestatus ELSE 'p' || l.l_partkey END AS text
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = o.o_orderkey % 9 WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem)) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY text DESC) = 1""")
def provision_texts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), "l_returnflag")
    o = table(spark, sf_dir, "orders").join(lines.select("o_orderkey").distinct(), "o_orderkey", "left_semi")
    at = F.col("o_orderkey") % 9
    o = o.join(lines.withColumnRenamed("o_orderkey", "k"), (F.col("k") == F.col("o_orderkey")) & (F.col("n") == at), "left")
    refs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("law_id"), F.concat(F.lit("ART_"), "o_orderkey").alias("article_id"), at.cast("string").alias("para_no"), F.col("l_returnflag").alias("item_no"), F.lit(None).cast("string").alias("subitem_no"))
    return st.provision_text(refs, st.units(st.articles(_laws(spark, sf_dir))), "id")


@query("""SELECT o_custkey AS law_id, o_orderkey AS addendum, l_linenumber AS unit_no, l_returnflag AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 7 = o_custkey % 7""")
def current_addenda(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("addendum")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("unit_no"), F.col("l_returnflag").alias("text"))).alias("units"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law_id"), F.col("o_orderkey").alias("addendum"), F.lpad((F.col("o_orderkey") % 7).cast("string"), 5, "0").alias("promulgation_no"))
    laws = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law_id"), (F.col("o_custkey") % 7).cast("string").alias("current_no")).distinct()
    return st.current_addenda(o.join(units, "addendum"), laws).select("law_id", "addendum", "unit_no", "text")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'F' || (l_suppkey % 10) END AS family, l_suppkey AS law, l_partkey % 50 AS no FROM lineitem),
s AS (SELECT 'F' || (p_partkey % 10) AS family, p_partkey % 50 AS no, 'P' || min(p_partkey) AS version FROM part GROUP BY 1, 2), i AS (SELECT s_suppkey AS law, s_suppkey % 50 AS no, s_name AS version FROM supplier)
SELECT l_orderkey, l_linenumber, coalesce(s.version, i.version) AS version, CASE WHEN s.version IS NOT NULL THEN 'snapshot' WHEN i.version IS NOT NULL THEN 'index' ELSE 'model' END AS route
FROM c LEFT JOIN s ON s.family = c.family AND s.no = c.no LEFT JOIN i ON i.law = c.law AND i.no = c.no""")
def citation_versions(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("F"), F.col("l_suppkey") % 10)).alias("family"), F.col("l_suppkey").alias("law"), (F.col("l_partkey") % 50).alias("promulgation_no"), F.lit(True).alias("is_prior_version"))
    p = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("F"), F.col("p_partkey") % 10).alias("family"), (F.col("p_partkey") % 50).alias("promulgation_no")).agg(F.concat(F.lit("P"), F.min("p_partkey")).alias("version"))
    i = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("law"), (F.col("s_suppkey") % 50).alias("promulgation_no"), F.col("s_name").alias("version"))
    return t.route_versions(c, p, i).select("l_orderkey", "l_linenumber", "version", "route")


@query("""SELECT key, page_id, site FROM (SELECT lower(trim(regexp_extract(url, '://[^/]+/([^/?#]*)', 1))) AS key, page_id, regexp_extract(url, '://([^/]+)', 1) AS site FROM pages WHERE starts_with(url, 'http')) WHERE key <> ''
QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1""")
def domain_map(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("site", F.regexp_extract("url", "://([^/]+)", 1))
    return m.map_first_wins(p, "url", "http", r"://[^/]+/([^/?#]*)", ["page_id"]).select("key", "page_id", "site")


@query("""SELECT key, p_partkey, p_size FROM (SELECT regexp_replace(p_brand || '/' || p_size, '#|/0*', '-', 'g') AS key, p_brand || '/' || p_size AS old, p_partkey, p_size FROM part) QUALIFY row_number() OVER (PARTITION BY key ORDER BY key <> old, p_partkey) = 1""")
def rename_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_size").alias("key"), "p_partkey", "p_size")
    return m.rename_keys(p, "key", F.regexp_replace("key", "#|/0*", "-"), ["p_partkey"])


@query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'assistant'), f AS (SELECT conv_id, text AS fact FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)
SELECT c.conv_id || ':' || p AS key, sha256(c.text || chr(10) || substring(f.fact, 1, 500)) AS digest FROM c JOIN f USING (conv_id) WHERE trim(c.text) <> ''""")
def embed_inputs(spark, sf_dir):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.col("t")[0]["text"].alias("fact"), F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: x["text"]).alias("chains"))
    return r.embed_inputs(c, "conv_id", "fact", "chains").select("key", F.sha2("text", 256).alias("digest"))


@query("""SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus))::INTEGER AS issue_no, l_linestatus AS title, count(*) AS n_chains,
coalesce(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) FILTER (l_returnflag = 'R'), '') AS statutes FROM lineitem GROUP BY l_orderkey, l_linestatus""")
def core_issues(spark, sf_dir):
    cite = F.struct(F.when(F.col("l_returnflag") == "R", "statute").otherwise("case").alias("source_type"), F.col("l_partkey").cast("string").alias("ref"))
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linestatus").alias("title")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("chains"), F.collect_list(cite).alias("citations"))
    reports = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("title", "chains", "citations"))).alias("issues"))
    return r.core_issues(reports, "l_orderkey").select("l_orderkey", "issue_no", "title", F.size("chains").cast("long").alias("n_chains"), F.array_join(F.array_sort("statutes"), ",").alias("statutes"))


@query("""SELECT conv_id, role AS title, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1, 2""")
def group_sections(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    maps = g.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "texts"))).alias("groups"))
    return r.sections(maps, "conv_id", "groups").select("conv_id", "title", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", "\n"), 256).alias("digest"))


@query("""SELECT p_partkey, label, text FROM (SELECT p_partkey, unnest(['facts', 'claims', 'grounds', 'ruling', 'order']) AS label, unnest([p_name, p_brand, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_type END, p_size::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN p_brand || p_size END]) AS text FROM part) WHERE trim(coalesce(text, '')) <> ''""")
def five_narratives(spark, sf_dir):
    c = F.col
    return r.narratives(table(spark, sf_dir, "part"), "p_partkey", {"facts": c("p_name"), "claims": c("p_brand"), "grounds": F.when(c("p_size") % 3 == 0, " ").otherwise(c("p_type")), "ruling": c("p_size"), "order": F.when(c("p_partkey") % 2 == 0, F.concat("p_brand", "p_size"))})


@query("""WITH d AS (SELECT doc_id::VARCHAR AS k, CASE lang WHEN 'en' THEN 'addendum' WHEN 'de' THEN 'annex' WHEN 'es' THEN 'summary' ELSE 'revision' END AS kind, text, ceil(len(text) / 2000.0)::BIGINT AS n FROM documents WHERE trim(text) <> ''),
p AS (SELECT *, unnest(range(1, n + 1)) AS i FROM d)
SELECT CASE WHEN n > 1 THEN k || '_' || i ELSE k END AS id, kind, upper(kind[1]) || kind[2:] || CASE WHEN n > 1 THEN ' (part ' || i || ')' ELSE '' END AS title, sha256(substring(text, (i - 1) * 2000 + 1, 2000)) AS digest FROM p""")
def observation_inputs(spark, sf_dir):
    o = r.observations(table(spark, sf_dir, "documents"), "doc_id", "lang", "text", {"en": "addendum", "de": "annex", "fr": "revision", "es": "summary"}, 2000)
    return o.select("id", "kind", "title", F.sha2("text", 256).alias("digest"))
