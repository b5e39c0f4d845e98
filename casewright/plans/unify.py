"""Queries of law deliveries of mixed shape, built as JSON from the tables and projected back to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.operators import unified as u

from .registry import query, table


def _json(*parts) -> Column:
    """Texts and columns one after the other; strings that are names of columns stand in backquotes."""
    return F.concat(*[F.col(p[1:-1]) if isinstance(p, str) and p[:1] == "`" else F.lit(p) if isinstance(p, str) else p for p in parts])


def _quoted(c) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _one_or_many(array: Column) -> Column:
    """The only element itself, several as a list."""
    return F.when(F.size(array) == 1, array[0]).otherwise(F.concat(F.lit("["), F.array_join(array, ","), F.lit("]")))


@query(r"""WITH d AS (SELECT *, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10))[1] AS l FROM documents)
SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '법' ELSE '법 시행령' END AS law_name, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN lang END AS kind, lang AS ministry,
CASE WHEN doc_id % 3 = 0 THEN 'RULE' WHEN doc_id % 2 = 0 THEN 'LAW' ELSE 'DECREE' END AS source_type, sha256(t) AS amendment,
CASE WHEN doc_id % 4 > 0 THEN sha256(l || chr(10) || lang) END AS reason,
CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'ANNEX_7:' || sha256(t) || ':a.gif' ELSE 'ANNEX_1:' || sha256('x' || chr(10) || doc_id) || ':,ANNEX_2:' || sha256(t) || ':a.gif;b.gif' END AS annexes,
CASE doc_id % 4 WHEN 0 THEN '-' || source WHEN 1 THEN '20200101' || source || ' ' || lang WHEN 2 THEN '20200101' || source || '|-' || lang || ' ' || doc_id || '|-' || source ELSE '' END AS addenda FROM d""")
def unified_headers(spark, sf_dir):
    """A law for each document: its text as lines nested up to nine lists deep, parts that are missing, one node or many."""
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    deep = (F.col("doc_id") % 9).cast("int")
    # the first line by itself, the others deeper and deeper
    nested = F.when(deep == 0, F.to_json(lines)).otherwise(F.concat(F.repeat(F.lit("["), deep), _quoted(lines[0]), F.when(F.size(lines) > 1, F.concat(F.lit(","), F.to_json(F.slice(lines, 2, 1 << 30)))).otherwise(""), F.repeat(F.lit("]"), deep)))
    d = d.withColumns({"nested": nested, "first": _quoted(lines[0]), "lang_": _quoted(F.col("lang")), "source_": _quoted(F.col("source"))})
    by = lambda n, *cases: F.element_at(F.array(*cases), (F.col("doc_id") % n + 1).cast("int"))
    id_ = F.col("doc_id").cast("string")
    kind = by(3, _json('{"content":"","code":"총리령"}'), _json('{"content":', "`lang_`", ',"code":"x"}'), _json("null"))
    ministry = by(2, F.col("lang_"), _json('{"content":', "`lang_`", "}"))
    name = _json('"', "`source`", by(2, F.lit("법"), F.lit("법 시행령")), '"')
    reason = by(4, _json("null"), *[_json('{"제개정이유내용":[[', "`first`", "],", "`lang_`", "]}")] * 3)
    one = _json('{"별표번호":"7","별표내용":', "`nested`", ',"별표이미지파일명":"a.gif"}')
    two = _json('[{"별표번호":1,"별표내용":["x",[', id_, ']]},"stray",{"별표번호":"2","별표내용":', "`nested`", ',"별표이미지파일명":["a.gif",["b.gif"]]}]')
    annexes = by(3, _json("null"), _json('{"별표단위":', one, "}"), _json('{"별표단위":', two, "}"))
    addendum = _json('{"부칙공포일자":"20200101","부칙내용":', "`source_`", "}")
    addenda = by(4, _json('{"부칙단위":" ', "`source`", ' "}'), _json('{"부칙단위":{"부칙공포일자":20200101,"부칙내용":[[', "`source_`", "],[[", "`lang_`", "]]]}}"), _json('{"부칙단위":[', addendum, ",[", "`lang_`", ",[", id_, "]],", "`source_`", "]}"), _json("null"))
    raw = _json('{"법령":{"기본정보":{"법령ID":', id_, ',"법령명_한글":', name, ',"법종구분":', kind, ',"소관부처":', ministry, '},"개정문":{"개정문내용":', "`nested`", '},"제개정이유":', reason, ',"별표":', annexes, ',"부칙":', addenda, "}}")
    h = d.select("doc_id", u.header(F.parse_json(raw)).alias("h"))
    annex = F.transform("h.annexes", lambda a: F.concat(a["id"], F.lit(":"), F.sha2(a["content_raw"], 256), F.lit(":"), F.array_join(a["images"], ";")))
    told = F.transform("h.addenda", lambda a: F.concat(F.coalesce(a["date"], F.lit("-")), a["content"]))
    return h.select("doc_id", "h.law_name", "h.kind", "h.ministry", "h.source_type", F.sha2(F.col("h.amendments")[0]["text"], 256).alias("amendment"), F.sha2(F.get("h.revision_reasons", F.lit(0))["text"], 256).alias("reason"), F.array_join(annex, ",").alias("annexes"), F.array_join(told, "|").alias("addenda"))


@query("""WITH o AS (SELECT *, count(*) FILTER (o_orderkey % 11 = 0) OVER w AS k, max(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END) OVER w AS ch FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
s AS (SELECT *, max(CASE WHEN o_orderkey % 11 = 5 THEN o_orderkey END) OVER (PARTITION BY o_custkey, k ORDER BY o_orderkey) AS sec FROM o),
p AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_shipdate::DATE || ':' || (l_returnflag = 'R') || '[' || CASE WHEN l_linenumber % 2 = 0 THEN l_partkey || '=' || l_linestatus || '(가' || l_suppkey || ')' ELSE '' END || ']', ';' ORDER BY l_linenumber, l_shipdate, l_returnflag = 'R', l_partkey::VARCHAR) AS paragraphs FROM lineitem GROUP BY 1)
SELECT o_custkey AS law_id, o_orderkey, coalesce('CH_' || ch, 'CH_0') AS chapter_id, coalesce('CH_' || ch, 'CH_0') || '_SEC_' || sec AS section_id,
'ART_' || o_orderkey || CASE WHEN o_orderkey % 4 = 1 THEN '_3' ELSE '' END AS article_id, '제' || o_orderkey || '조' || CASE WHEN o_orderkey % 4 = 1 THEN '의3' ELSE '' END || ' ' || o_orderpriority AS title,
o_orderstatus = 'F' AS changed, paragraphs FROM s JOIN p ON l_orderkey = o_orderkey WHERE o_orderkey % 11 NOT IN (0, 5)""")
def unified_law_articles(spark, sf_dir):
    """A law for each customer: orders as chapter, section or article entries; line items as paragraphs, one node or a list."""
    item = _json('{"호번호":', F.col("l_partkey").cast("string"), ',"호내용":"1. ', "`l_linestatus`", '","목":{"목번호":"가","목내용":["가', F.col("l_suppkey").cast("string"), '"]}}')
    items = F.when(F.col("l_linenumber") % 4 == 0, _json(',"호":[', item, ',"stray"]')).when(F.col("l_linenumber") % 2 == 0, _json(',"호":', item)).otherwise("")
    kind = F.when(F.col("l_returnflag") == "R", "전부개정").otherwise("기타")
    para = _json('{"항번호":', F.col("l_linenumber").cast("string"), ',"항내용":"① ', F.col("l_shipdate").cast("date").cast("string"), '","항제개정유형":"', kind, '"', items, "}")
    paras = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", para.alias("p")))).alias("ps"))
    no = F.col("o_orderkey").cast("string")
    head = lambda unit: _json('{"조문여부":"전문","조문번호":', no, ',"조문내용":" 제', no, unit, ' 총칙 "}')
    sub = F.when(F.col("o_orderkey") % 4 == 1, "의3").otherwise("")
    title = _json('"제', no, "조", sub, " ", "`o_orderpriority`", '"')
    body = F.when(F.col("o_orderkey") % 3 == 0, _json("[[", title, "]]")).otherwise(title)
    article = _json('{"조문번호":', no, ',"조문내용":', body, ',"조문변경여부":"', F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N"), '","항":', _one_or_many(F.col("ps.p")), "}")
    entry = F.when(F.col("o_orderkey") % 11 == 0, head("장")).when(F.col("o_orderkey") % 11 == 5, head("절")).otherwise(article)
    o = table(spark, sf_dir, "orders").join(paras, "o_orderkey", "left").filter("ps IS NOT NULL OR o_orderkey % 11 IN (0, 5)")
    laws = o.groupBy(F.col("o_custkey").alias("law_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("e")))).alias("es"))
    laws = laws.select("law_id", F.parse_json(_json('{"법령":{"조문":{"조문단위":', _one_or_many(F.col("es.e")), "}}}")).alias("law"))
    a = u.unified_articles(laws)
    under = lambda i: F.concat(i["item_no"], F.lit("="), i["text"], F.lit("("), F.array_join(F.transform(i["subitems"], lambda s: s["text"]), ","), F.lit(")"))
    told = F.transform("paragraphs", lambda p: F.concat(p["para_no"], F.lit(":"), p["text"], F.lit(":"), p["changed"].cast("string"), F.lit("["), F.array_join(F.transform(p["items"], under), ","), F.lit("]")))
    return a.select("law_id", F.regexp_extract("article_no", r"^(\d+)", 1).cast("long").alias("o_orderkey"), "chapter_id", "section_id", "article_id", "title", "changed", F.array_join(told, ";").alias("paragraphs"))
