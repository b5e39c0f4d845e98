"""Text queries. Citations of Korean statutes are made from the tables' numbers, so that every row of a table is parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.functions import variants as va

from .registry import query, table

_CITE = "'소득세법 시행령 제' || l_partkey || '조' || CASE WHEN l_linenumber > 3 THEN '의' || l_linenumber ELSE '' END || CASE WHEN l_suppkey % 2 = 0 THEN ' 제' || (l_suppkey % 9 + 1) || '항' ELSE '' END"


def _cites(spark, sf_dir):
    n = F.col("l_linenumber")
    c = F.concat(F.lit("소득세법 시행령 제"), "l_partkey", F.lit("조"), F.when(n > 3, F.concat(F.lit("의"), n)).otherwise(""), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" 제"), F.col("l_suppkey") % 9 + 1, F.lit("항"))).otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", c.alias("cite"))


@query(rf"""SELECT law, article_id, paragraph, count(*) AS n FROM (SELECT regexp_extract(c, '^(.+?)\s+제(\d+)조', 1) AS law,
'ART_' || regexp_extract(c, '제(\d+)조', 1) || CASE WHEN regexp_extract(c, '조의(\d+)', 1) <> '' THEN '_' || regexp_extract(c, '조의(\d+)', 1) ELSE '' END AS article_id, nullif(regexp_extract(c, '제(\d+)항', 1), '') AS paragraph
FROM (SELECT {_CITE} AS c FROM lineitem)) GROUP BY ALL""")
def citation_parse(spark, sf_dir):
    p = _cites(spark, sf_dir).select(x.parse_target(F.col("cite")).alias("p")).select("p.law", "p.article_id", "p.paragraph")
    return p.groupBy("law", "article_id", "paragraph").agg(F.count("*").alias("n"))


_CASES = "SELECT doc_id, text || ' 대법원 ' || (2000 + doc_id % 25) || '두' || doc_id || ' 그리고 조심 2022서' || (doc_id % 50) || ', ' || (2000 + doc_id % 25) || '두' || doc_id AS t FROM documents"


def _case_texts(spark, sf_dir):
    d, no = table(spark, sf_dir, "documents"), F.concat((F.lit(2000) + F.col("doc_id") % 25).cast("string"), F.lit("두"), "doc_id")
    t = F.concat("text", F.lit(" 대법원 "), no, F.lit(" 그리고 조심 2022서"), F.col("doc_id") % 50, F.lit(", "), no)
    return d.select("doc_id", t.alias("t"))


@query(rf"""WITH c AS ({_CASES}), e AS (SELECT doc_id, unnest(regexp_extract_all(t, '{x.CASE_NUMBER}')) AS cited, generate_subscripts(regexp_extract_all(t, '{x.CASE_NUMBER}'), 1) AS i FROM c)
SELECT doc_id, cited, min(i)::INTEGER AS first_at FROM e GROUP BY 1, 2""")
def citation_extract(spark, sf_dir):
    # a case that stands with and without its court is two citations, as written; positions count every match
    hits = F.regexp_extract_all("t", F.lit(x.CASE_NUMBER), F.lit(0))
    e = _case_texts(spark, sf_dir).select("doc_id", F.posexplode(x.cited(F.col("t"))).alias("p", "cited"), hits.alias("h"))
    return e.select("doc_id", "cited", F.array_position("h", F.col("cited")).cast("int").alias("first_at"))


@query(rf"""WITH c AS ({_CASES}) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN t ELSE
 substring(t, 1, len(t) - len(a) - len(b) - len(no) - 7) || '**[unverified: ' || a || ']** 그리고 ' || b || ', **[unverified: ' || no || ']**' END AS t,
 CASE WHEN doc_id % 2 = 0 THEN '' ELSE no || '|' || a END AS unverified
FROM (SELECT *, '대법원 ' || no AS a, '조심 2022서' || (doc_id % 50) AS b FROM (SELECT *, (2000 + doc_id % 25) || '두' || doc_id AS no FROM c))""")
def citation_guard(spark, sf_dir):
    d = _case_texts(spark, sf_dir)
    no = F.concat((F.lit(2000) + F.col("doc_id") % 25).cast("string"), F.lit("-두-"), "doc_id")
    known = d.filter("doc_id % 2 = 0").select(F.concat(F.lit("대법원-"), no).alias("case_no"), no.alias("case_id"), F.lit(None).cast("string").alias("dem_no"))
    tribunal = d.select(F.concat(F.lit("조심 2022서"), F.col("doc_id") % 50).alias("dem_no")).distinct()
    valid = x.valid_ids(known.unionByName(tribunal, allowMissingColumns=True), ["case_no", "case_id", "dem_no"])
    return x.guard(d, "doc_id", "t", valid)


@query(r"SELECT doc_id, substring(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 12) AS id12, substring(sha256(source || '|' || lang), 1, 16) AS pair16 FROM documents")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.stable_id(F.col("text")).alias("id12"), x.pair_id(F.col("source"), F.col("lang")).alias("pair16"))


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(x.strip_html(F.col("html")), 256).alias("digest"))


@query(r"""SELECT page_id, 'P' || page_id AS title, trim(regexp_extract(url, '://([^/]+)', 1)) AS site FROM pages""")
def field_extract(spark, sf_dir):
    site = F.regexp_extract("url", "://([^/]+)", 1)
    t = F.concat(F.lit("x [제목] P"), "page_id", F.lit(" [관련법령]  "), site, F.lit("      rest"))
    return table(spark, sf_dir, "pages").select("page_id", x.field(t, "제목").alias("title"), x.field(t, "관련법령").alias("site"))


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'narrative' WHEN d.n_chars > 2000 THEN 'raw' ELSE 'pdf' END AS label, CASE WHEN l.quality = 1 THEN 'q' || l.doc_id WHEN d.n_chars > 2000 THEN d.source ELSE d.lang END AS text
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def text_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left")
    text, label = x.first_nonblank({"narrative": F.when(F.col("quality") == 1, F.concat(F.lit("q"), "id")), "raw": F.when(F.col("n_chars") > 2000, F.col("source")).otherwise("  "), "pdf": F.col("lang")})
    return d.select("doc_id", label.alias("label"), text.alias("text"))


@query("""SELECT doc_id, substring('[title] ' || source || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '[lang] ' || lang || chr(10) END || '[body] ' || trim(text), 1, 500) AS doc FROM documents WHERE len(trim(text)) >= 50""")
def doc_text_build(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.length(F.trim("text")) >= 50)
    doc = x.tagged_text({"title": F.col("source"), "lang": F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")), "body": F.col("text")}, 500)
    return d.select("doc_id", doc.alias("doc"))


@query("""SELECT p_partkey, 'ART_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '_' || (p_partkey % 5 + 1) ELSE '' END AS article_id, p_size = 1 AS of_first,
row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 + 1 ELSE 0 END, p_partkey)::INTEGER AS pos FROM part""")
def natural_sort_match(spark, sf_dir):
    from pyspark.sql import Window

    raw = F.concat("p_size", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" 의 "), F.col("p_partkey") % 5 + 1)).otherwise("조"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.concat(F.lit("ART_"), x.article_input(raw)).alias("article_id"))
    p = p.withColumn("of_first", x.article_matches(F.col("article_id"), F.lit("ART_1")))
    place = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy(*x.natural_order(F.col("article_id")), "p_partkey"))
    return p.withColumn("pos", place).drop("p_brand", "p_type")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '국패' WHEN 'P' THEN '일부국패' ELSE '국승' END AS decision, o_orderstatus <> 'O' AS win FROM orders""")
def synonym_normalise(spark, sf_dir):
    raw = F.when(F.col("o_orderstatus") == "F", " 납세자승소").when(F.col("o_orderstatus") == "P", "일부승소 ").otherwise("국가승소")
    d = x.lookup(raw, x.DECISIONS)
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("decision"), x.is_win("court", d).alias("win"))


@query("""SELECT event_id, list_extract(string_split(substring(props, 2, len(props) - 2), ': '), 2)::BIGINT AS k, (list_extract(string_split(substring(props, 2, len(props) - 2), ': '), 2)::BIGINT) BETWEEN 10 AND 50 AS in_range FROM events""")
def json_field_range(spark, sf_dir):
    k = F.get_json_object(x.repaired_json(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))), "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.between(10, 50).alias("in_range"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '|' || user_id WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN event_type WHEN 3 THEN '' ELSE event_type || '|' || user_id END AS entries FROM events""")
def unwrapped_answers(spark, sf_dir):
    """Answers that should be a list: one as asked, under a known or an only field, alone, or empty, with empty entries among them."""
    kind, user = F.concat(F.lit('{"k":"'), "event_type", F.lit('"}')), F.concat(F.lit('{"k":"'), "user_id", F.lit('"}'))
    said = F.element_at(F.array(
        F.concat(F.lit("["), kind, F.lit(",{},"), user, F.lit("]")), F.concat(F.lit('{"note":1,"items":[{},'), user, F.lit("]}")), kind, F.lit('{"found":[{}]}'),
        F.concat(F.lit('{"found":['), kind, F.lit(","), user, F.lit("]}"))), (F.col("event_id") % 5 + 1).cast("int"))
    entries = va.unwrapped(F.try_parse_json(said))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(entries, lambda e: va.scalar(va.field(e, "k"))), "|").alias("entries"))
