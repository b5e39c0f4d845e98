"""Laws as their source delivers them (JSON of mixed shape) projected to typed columns: a header and rows of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.functions import variants as v

from .segment import carry

#: Kinds of change that mark a paragraph as changed (fixed values).
CHANGED = ("개정", "신설", "전부개정")


def _joined(c: Column, between: str) -> Column:
    return F.array_join(F.transform(v.texts(c), lambda t: F.trim(t)), between)


def plain(c: Column) -> Column:
    """A text, or lists of texts as one, without a leading circled digit or number; markup stays as it is; '' for null."""
    bare = lambda t: F.trim(F.regexp_replace(t, r"^[①②③④⑤⑥⑦⑧⑨⑩\d]+\s*[.)]?\s*", ""))
    whole = lambda u: F.coalesce(v.scalar(u), _joined(u, " "))
    return v.once(c, lambda u: v.once(whole(u), lambda t: F.when(t.rlike(r"(?s)<.*>") & ~v.is_list(u), F.trim(t)).otherwise(bare(t))))


def _name(c: Column) -> Column:
    """A text, or a node's content."""
    return F.when(v.is_node(c), v.scalar(v.field(c, "content"))).otherwise(v.scalar(c))


def _block(outer: Column, inner: str) -> Column:
    """An array of one struct with the lines of a field, one under the other; empty where the outer node is missing."""
    told = F.array(F.struct(F.array_join(v.texts(v.field(outer, inner)), "\n").alias("text")))
    return F.when(v.is_node(outer), told).otherwise(F.filter(told, lambda _: F.lit(False)))


def header(law: Column) -> Column:
    """Struct of a law's own fields (``law``: the whole delivery as VARIANT).

    law_id, law_name, effective, promulgated, promulgation_no, kind, ministry, source_type, and arrays: revision_reasons and
    amendments (text), annexes (id, title, number, content_raw, images, pdf, hwp), addenda (date, content). Each part may be
    missing, one node or many; texts may be lists in lists to any depth; kind and ministry may be a text or a node with
    content. A missing text is empty, other missing fields are null.
    """
    root = lambda *names: v.field(law, "법령", *names)
    meta = lambda name: v.field(law, "법령", "기본정보", name)
    kind = meta("법종구분")
    by_code = F.when(v.is_node(kind), F.coalesce(x.blank_to_null(v.scalar(v.field(kind, "content"))), v.scalar(v.field(kind, "code")))).otherwise(v.scalar(kind))
    annex = lambda u: F.struct(
        F.concat(F.lit("ANNEX_"), F.coalesce(v.scalar(v.field(u, "별표번호")), F.lit(""))).alias("id"), v.scalar(v.field(u, "별표제목")).alias("title"), v.scalar(v.field(u, "별표번호")).alias("number"),
        F.array_join(v.texts(v.field(u, "별표내용")), "\n").alias("content_raw"), v.texts(v.field(u, "별표이미지파일명")).alias("images"),
        v.scalar(v.field(u, "별표PDF파일명")).alias("pdf"), v.scalar(v.field(u, "별표HWP파일명")).alias("hwp"))
    addendum = lambda u: F.struct(
        v.scalar(v.field(u, "부칙공포일자")).alias("date"), F.when(v.is_node(u), _joined(v.field(u, "부칙내용"), " ")).otherwise(_joined(u, " ")).alias("content"))
    return F.struct(
        v.scalar(meta("법령ID")).alias("law_id"), v.scalar(meta("법령명_한글")).alias("law_name"), v.scalar(meta("시행일자")).alias("effective"),
        v.scalar(meta("공포일자")).alias("promulgated"), v.scalar(meta("공포번호")).alias("promulgation_no"), _name(kind).alias("kind"), _name(meta("소관부처")).alias("ministry"),
        x.source_type(by_code, v.scalar(meta("법령명_한글"))).alias("source_type"),
        _block(root("제개정이유"), "제개정이유내용").alias("revision_reasons"), _block(root("개정문"), "개정문내용").alias("amendments"),
        F.transform(v.nodes(root("별표", "별표단위")), annex).alias("annexes"), F.transform(v.many(root("부칙", "부칙단위")), addendum).alias("addenda"))


def _article(e: Column) -> list[Column]:
    sub = lambda m: F.struct(v.scalar(v.field(m, "목번호")).alias("subitem_no"), plain(v.field(m, "목내용")).alias("text"))
    item = lambda h: F.struct(v.scalar(v.field(h, "호번호")).alias("item_no"), plain(v.field(h, "호내용")).alias("text"), F.transform(v.nodes(v.field(h, "목")), sub).alias("subitems"))
    para = lambda p: F.struct(
        v.scalar(v.field(p, "항번호")).alias("para_no"), plain(v.field(p, "항내용")).alias("text"), F.coalesce(v.scalar(v.field(p, "항제개정유형")).isin(*CHANGED), F.lit(False)).alias("changed"),
        v.scalar(v.field(p, "항제개정일자문자열")).alias("effective_date"), F.transform(v.nodes(v.field(p, "호")), item).alias("items"))
    lines = F.transform(v.texts(v.field(e, "조문내용")), lambda t: F.trim(F.when(t.rlike(r"(?s)<.*>"), t).otherwise(F.regexp_replace(t, r"^[①②③④⑤⑥⑦⑧⑨⑩\d]+\s*[.)]?\s*", ""))))
    return [
        F.array_join(F.filter(lines, lambda t: t != ""), "\n").alias("raw_text"), (F.coalesce(v.scalar(v.field(e, "조문변경여부")), F.lit("")) == "Y").alias("changed"),
        v.scalar(v.field(e, "조문시행일자")).alias("effective_date"), v.texts(v.field(e, "조문참고자료")).alias("reference_notes"), F.transform(v.nodes(v.field(e, "항")), para).alias("paragraphs")]


def unified_articles(laws: DataFrame, law: str = "law", key: str = "law_id", strict: bool = False) -> DataFrame:
    """A row for each article: its place in the law, the chapter, section and subdivision it stands under, and its typed content.

    key, pos, chapter_id, chapter, section_id, section, subdivision_id, subdivision, article_id, article_no, title, raw_text,
    changed, effective_date, reference_notes, paragraphs (para_no, text, changed, effective_date, items (item_no, text,
    subitems (subitem_no, text))). One node counts as a list of one; elements that are no nodes are left out. Before the
    first chapter the chapter is CH_0, or, if ``strict``, the plan fails there.
    """
    rows = laws.select(key, F.posexplode(v.nodes(v.field(F.col(law), "법령", "조문", "조문단위"))).alias("pos", "e"))
    e = F.col("e")
    rows = rows.withColumn("title", F.trim(_joined(v.field(e, "조문내용"), " "))).withColumn("number", v.scalar(v.field(e, "조문번호")))
    kind = F.when(v.scalar(v.field(e, "조문여부")) == "조문", "article").otherwise(x.unit_kind(F.col("title")))
    rows = rows.withColumn("kind", kind)
    no = lambda unit: F.coalesce(x.unit_no(F.col("title"), unit), "number")
    head = lambda name, unit: F.when(F.col("kind") == name, F.struct(no(unit).alias("no"), F.col("title").alias("name")))
    rows = carry(rows, key, ["pos"], {"chapter": head("chapter", "장"), "section": head("section", "절"), "subdivision": head("subdivision", "관")})
    first = F.raise_error(F.lit("an article stands before the first chapter")).cast("string") if strict else F.lit("CH_0")
    chapter = F.when(F.col("chapter").isNotNull(), F.concat(F.lit("CH_"), "chapter.no")).otherwise(first)
    section = F.concat("chapter_id", F.lit("_SEC_"), "section.no")
    out = rows.filter("kind = 'article'").withColumn("chapter_id", chapter).withColumn("section_id", section)
    number = no("조")
    return out.select(
        key, "pos", "chapter_id", F.col("chapter.name").alias("chapter"), "section_id", F.col("section.name").alias("section"),
        F.concat(F.coalesce("section_id", "chapter_id"), F.lit("_SUB_"), "subdivision.no").alias("subdivision_id"), F.col("subdivision.name").alias("subdivision"),
        F.concat(F.lit("ART_"), number).alias("article_id"), number.alias("article_no"), "title", *_article(e))
