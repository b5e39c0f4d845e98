"""Queries of names, headings, labels and dates. Korean inputs are made from the tables' numbers, so that every row is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.operators import segment as s
from casewright.operators import statute as st
from casewright.operators import temporal as t
from casewright.operators import vector as v

from .registry import query, table


def _by(column, values):
    """One of several values by a number's remainder; None is null."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for i, value in enumerate(values):
        value = F.lit(value) if value is None or isinstance(value, str) else value
        out = F.when(c % len(values) == i, value) if out is None else out.when(c % len(values) == i, value)
    return out


_KIND = "['chapter', 'section', 'subdivision', 'article', NULL][(o_orderkey % 5 + 1)::INT]"


@query(f"""WITH h AS (SELECT o_custkey AS law_id, o_orderkey AS pos, {_KIND} AS kind, (o_orderkey % 90 + 1) || CASE WHEN o_orderkey % 2 = 0 THEN '_' || (o_orderkey % 3 + 2) ELSE '' END AS no FROM orders),
c AS (SELECT *, last_value(CASE WHEN kind = 'chapter' THEN no END IGNORE NULLS) OVER w AS ch, count(*) FILTER (kind = 'chapter') OVER w AS k1 FROM h WINDOW w AS (PARTITION BY law_id ORDER BY pos)),
d AS (SELECT *, last_value(CASE WHEN kind = 'section' THEN no END IGNORE NULLS) OVER w AS section, count(*) FILTER (kind = 'section') OVER w AS k2 FROM c WINDOW w AS (PARTITION BY law_id, k1 ORDER BY pos))
SELECT law_id, pos, kind, coalesce(ch, 'CH_0') AS chapter, section, last_value(CASE WHEN kind = 'subdivision' THEN no END IGNORE NULLS) OVER (PARTITION BY law_id, k1, k2 ORDER BY pos) AS subdivision FROM d""")
def statute_headings(spark, sf_dir):
    n = (F.col("o_orderkey") % 90 + 1).cast("string")
    sub = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("의"), F.col("o_orderkey") % 3 + 2)).otherwise("")
    line = _by("o_orderkey", [F.concat(F.lit("제"), n, F.lit(u), sub, F.lit(" 총칙")) for u in "장절관조"] + [F.concat(F.lit("① 이 법은 제"), n, F.lit("조"))])
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law_id"), F.col("o_orderkey").alias("pos"), line.alias("text"))
    return st.headings(lines).select("law_id", "pos", "kind", "chapter", "section", "subdivision")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'LAW' WHEN 1 THEN 'DECREE' WHEN 2 THEN 'RULE' WHEN 3 THEN 'RULE' ELSE ['LAW', 'DECREE', 'RULE', 'UNKNOWN'][(p_partkey % 4 + 1)::INT] END AS source_type,
['law', 'decree', 'rule', 'law'][(p_partkey % 4 + 1)::INT] AS kind, CASE WHEN p_partkey % 4 = 3 THEN p_name || ' 고시' ELSE p_name || '법' END AS base FROM part""")
def law_kinds(spark, sf_dir):
    name = F.concat("p_name", _by("p_partkey", ["법", "법 시행령", "법 시행규칙", " 고시"]))
    kind = _by("p_size", ["법률", "대통령령", "재정경제부령", "총리령", None])
    return table(spark, sf_dir, "part").select("p_partkey", x.source_type(kind, name).alias("source_type"), x.law_kind(name).alias("kind"), x.base_law(name).alias("base"))


@query(r"""WITH d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '① ' WHEN 1 THEN (doc_id % 90 + 1) || ') ' ELSE '2023.5 ' END AS head FROM documents)
SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 2 OR regexp_matches(text, '<.*>') THEN trim(head || text) ELSE trim(regexp_replace(text, '^\s+', '')) END) AS digest,
'제 ' || (doc_id % 9 + 1) || ' 장 총칙' AS title, '제' || (doc_id % 9 + 1) || '장' AS chapter FROM d""")
def title_cleanup(spark, sf_dir):
    head = _by("doc_id", ["① ", F.concat((F.col("doc_id") % 90 + 1).cast("string"), F.lit(") ")), "2023.5 "])
    title = x.norm_title(F.concat(F.lit("  제 "), F.col("doc_id") % 9 + 1, F.lit("  장   총칙 <개정 "), "lang", F.lit(">  ")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(x.strip_enumerator(F.concat(head, "text")), 256).alias("digest"), title.alias("title"))
    return d.withColumn("chapter", x.chapter_key(F.col("title")))


_LAWS = ["소득세법", "소득세법 시행령", "국세기본법", "조세특례제한법"]


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '소득세법' WHEN 2 THEN '법인세법 시행령' END AS law_name,
CASE o_custkey % 5 WHEN 0 THEN '소득세법' WHEN 1 THEN '소득세법 시행령' WHEN 2 THEN '소득세법 시행령' WHEN 3 THEN '국세기본법' END AS asked, o_custkey % 3 < 2 AS cross_border FROM orders""")
def law_mentions(spark, sf_dir):
    target = _by("o_orderkey", ["소득세법의 제65조의2", "제22조제2항", "법인세법 시행령에 따른 제89조", "가 제3조"])
    asked = F.concat(F.lit("문의: "), _by("o_custkey", ["소득세법", "소득세법 시행령", "소득세법시행령", "국세기본법", "민법"]), F.lit(" 제1조 "), _by("o_custkey", ["정상가격 산출", "Pillar 2 적용", "일반 거래"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", x.law_name(target).alias("law_name"), x.law_in_question(asked, _LAWS).alias("asked"), x.any_of(asked, x.CROSS_BORDER).alias("cross_border"))


@query("""WITH c AS (SELECT *, (1990 + o_orderkey % 30)::VARCHAR AS y, ['두', '구합', '누', '도', '고합', '가합'][(o_orderkey % 6 + 1)::INT] AS code FROM orders)
SELECT o_orderkey, '서울고법' AS court, y || code || o_orderkey AS case_no, y AS year, CASE WHEN o_orderkey % 6 < 3 THEN 'ADMIN' WHEN o_orderkey % 6 < 5 THEN 'CRIMINAL' ELSE 'UNKNOWN' END AS case_type,
CASE WHEN o_custkey % 3 < 2 THEN y || code || o_orderkey END AS case_id, CASE WHEN o_custkey % 4 = 0 THEN 'none' ELSE '서울고법' || y || code || o_orderkey END AS file FROM c""")
def case_files(spark, sf_dir):
    no = F.concat((F.lit(1990) + F.col("o_orderkey") % 30).cast("string"), _by("o_orderkey", ["두", "구합", "누", "도", "고합", "가합"]), "o_orderkey")
    # the third form runs on into a letter, so it is no case number
    mention = _by("o_custkey", [F.concat(F.lit("사건 "), no, F.lit(" 판결")), F.concat(F.lit("("), no, F.lit(")")), F.concat(F.lit("가"), no, F.lit("나"))])
    name = _by("o_custkey", [F.lit(' /?*, '), F.concat(F.lit("서울고법 "), no), F.concat(F.lit("서울/고법:"), no), F.concat(F.lit("서울고법("), no, F.lit(")"))])
    parts = x.file_parts(F.concat(F.lit("서울고법_"), no))
    return table(spark, sf_dir, "orders").select("o_orderkey", parts.alias("p"), x.case_id_of(mention).alias("case_id"), x.safe_name(name, "none").alias("file")).select("o_orderkey", "p.court", "p.case_no", "p.year", "p.case_type", "case_id", "file")


@query("""WITH c AS (SELECT conv_id, turn, ['argument_plaintiff', 'argument_defendant', 'reasoning_core', 'statute', 'fact', 'heading'][(turn % 6 + 1)::INT] AS kind,
CASE role WHEN 'user' THEN 'argument_plaintiff' WHEN 'assistant' THEN 'conclusion' ELSE 'intro' END AS role FROM conversations)
SELECT conv_id, turn, CASE WHEN kind LIKE 'argument%' THEN substring(kind, 10) WHEN kind IN ('reasoning_core', 'statute') THEN 'court' WHEN role LIKE 'argument%' THEN substring(role, 10) WHEN role = 'conclusion' THEN 'court' END AS speaker,
CASE WHEN kind = 'fact' OR kind LIKE 'argument%' THEN kind WHEN kind = 'statute' THEN 'legal_basis' WHEN kind = 'reasoning_core' THEN 'reasoning' WHEN role = 'conclusion' THEN 'outcome' ELSE 'other' END AS block FROM c""")
def speakers(spark, sf_dir):
    kind = _by("turn", ["argument_plaintiff", "argument_defendant", "reasoning_core", "statute", "fact", "heading"])
    role = F.when(F.col("role") == "user", "argument_plaintiff").when(F.col("role") == "assistant", "conclusion").otherwise("intro")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", x.speaker(kind, role).alias("speaker"), x.block_kind(kind, role).alias("block"))


@query("""SELECT conv_id, turn FROM conversations QUALIFY turn <= coalesce(max(turn) FILTER (len(text) % 3 = 0) OVER (PARTITION BY conv_id), turn)""")
def judgment_end(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.when(F.length("text") % 3 == 0, " 주문과 같이 판결한다.").otherwise("")))
    return s.truncate_after_last(c, "conv_id", "turn", x.ends_judgment(F.col("text"))).select("conv_id", "turn")


@query("""SELECT o_orderkey, ['CUP,TNMM', 'CUP,PSM', 'CUP,PSM', 'COST+,TNMM', 'CUP', 'CUP', 'CUP,RPM', 'TNMM', 'TNMM'][(o_orderkey % 9 + 1)::INT] AS methods, o_totalprice * 20000 >= 5000000000 AS agreement FROM orders""")
def transfer_methods(spark, sf_dir):
    kind = _by("o_orderkey", [*x.METHODS, "대차"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(x.preferred_methods(kind), ",").alias("methods"), x.large_transaction(F.col("o_totalprice") * 20000).alias("agreement"))


@query("""SELECT o_orderkey, ['법인세', '종합소득세', '양도소득세', '부가가치세', '상속증여세', '종합부동산세', '국세징수', '국세기본', '국제조세', '지방세'][(o_orderkey % 10 + 1)::INT] AS tax FROM orders""")
def tax_types(spark, sf_dir):
    raw = _by("o_orderkey", [" 법인", "소득세", "양도 ", "부가", "증여세", "종부세", "징수", "국기법", "이전가격", "지방세"])
    return table(spark, sf_dir, "orders").select("o_orderkey", x.lookup(raw, x.TAXES).alias("tax"))


_BASE = "CASE WHEN l_suppkey % 2 = 0 THEN '소득세법' ELSE '법인세법' END"


@query(f"""SELECT l_orderkey, law, count(*) AS n FROM (SELECT l_orderkey, CASE l_partkey % 6 WHEN 0 THEN {_BASE} WHEN 1 THEN {_BASE} || ' 시행령' WHEN 2 THEN {_BASE} || ' 시행규칙' WHEN 3 THEN {_BASE} || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE ' 시행령' END WHEN 4 THEN {_BASE} || ' 시행령' END AS law FROM lineitem) GROUP BY ALL""")
def internal_references(spark, sf_dir):
    base = F.when(F.col("l_suppkey") % 2 == 0, "소득세법").otherwise("법인세법")
    citing = F.concat(base, F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(" 시행령"))
    target = F.concat(_by("l_partkey", ["이 법 ", "같은 법 시행령 ", "이 규칙 ", "", "해당 이 영 ", "민법 "]), F.lit("제"), "l_partkey", F.lit("조"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", x.internal_target(target, citing).alias("law"))
    return d.groupBy("l_orderkey", "law").agg(F.count("*").alias("n"))


@query("""SELECT page_id, CASE WHEN page_id < 7 THEN page_id::VARCHAR ELSE page_id || ',' || (page_id % 7) END AS ids FROM pages""")
def linked_ids(spark, sf_dir):
    a = F.concat(F.lit(' <a href="x?MST='), "page_id", F.lit('&y=1">'))
    h = F.concat(F.lit("MST=x "), a, "html", F.lit(" MST="), F.col("page_id") % 7, a)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(x.ids_in_links(h, "MST"), ",").alias("ids"))


@query("""SELECT c_custkey, c_mktsegment = 'BUILDING' AND (c_custkey % 3 = 0 OR DATE '2024-01-01' + (c_custkey % 400)::INT >= DATE '2024-06-30') AS access FROM customer""")
def subscriber_access(spark, sf_dir):
    level = F.when(F.col("c_mktsegment") == "BUILDING", "SUBSCRIBER").otherwise("FREE")
    until = F.when(F.col("c_custkey") % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 400).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", x.has_access(level, until, "2024-06-30").alias("access"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN o_orderdate::DATE WHEN 3 THEN date_trunc('month', o_orderdate)::DATE END AS day FROM orders""")
def date_inputs(spark, sf_dir):
    form = lambda f: F.date_format("o_orderdate", f)
    raw = _by("o_orderkey", [form("yyyy-MM-dd"), form("yyyy. MM. dd"), form(" yyyyMMdd "), form("yyyy/MM"), form("yyyy-MM-dd'T'HH")])
    return table(spark, sf_dir, "orders").select("o_orderkey", t.parse_date(raw).alias("day"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate::DATE <= DATE '1997-06-30' AND (o_custkey % 3 = 0 OR o_orderdate::DATE + (o_custkey % 900)::INT > DATE '1997-06-30')""")
def articles_in_force(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("effective", F.col("o_orderdate").cast("date"))
    o = o.withColumn("abolished", F.when(F.col("o_custkey") % 3 != 0, F.date_add("effective", (F.col("o_custkey") % 900).cast("int"))))
    return o.filter(t.in_force(F.lit("1997-06-30").cast("date"), "effective", "abolished")).select("o_orderkey", "o_custkey")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 3 ELSE 2 END AS n, sha256(CASE WHEN turn = 0 OR prev = '' THEN text ELSE substring(prev, 1, 300) || chr(10) || text END) AS digest
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)""")
def expanded_queries(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    # every other turn's variant is the query itself, so that it counts once
    variants = F.array(F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(" 요약"))).otherwise(F.col("role")))
    expanded = v.expand_query(F.col("role"), variants, "과세관청 처분 납세자 불복")
    return c.select("conv_id", "turn", F.size(expanded).alias("n"), F.sha2(s.context_query(F.col("text"), F.col("prev")), 256).alias("digest"))
