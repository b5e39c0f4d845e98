"""Nested statutes as flat units: levels, inherited domains, chapter texts, provision lookup, references between laws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as x

from .temporal import asof_or_oldest, latest_per_group


def articles(laws: DataFrame) -> DataFrame:
    """law_id, chapter, section, article and the domain: its own, else its section's, else its chapter's."""
    c = laws.select("law_id", F.posexplode("chapters").alias("chapter_pos", "c"))
    direct = c.select("law_id", "chapter_pos", F.col("c.id").alias("chapter_id"), F.col("c.domain").alias("d2"), F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("d1"), F.explode("c.articles").alias("a"))
    s = c.select("law_id", "chapter_pos", F.col("c.id").alias("chapter_id"), F.col("c.domain").alias("d2"), F.explode("c.sections").alias("s"))
    nested = s.select("law_id", "chapter_pos", "chapter_id", "d2", F.col("s.id").alias("section_id"), F.col("s.domain").alias("d1"), F.explode("s.articles").alias("a"))
    return direct.unionByName(nested).select("law_id", "chapter_pos", "chapter_id", "section_id", "a.*", F.coalesce("a.domain", "d1", "d2").alias("_domain")).withColumn("domain", F.col("_domain")).drop("_domain").withColumnRenamed("id", "article_id")


def units(arts: DataFrame) -> DataFrame:
    """law_id, article_id, level, para_no, item_no, subitem_no, text: a row for the article and for each part under it."""
    none = F.lit(None).cast("string")
    key = ["law_id", "article_id"]
    art = arts.select(*key, F.lit("ARTICLE").alias("level"), none.alias("para_no"), none.alias("item_no"), none.alias("subitem_no"), F.concat_ws("\n", "title", "raw_text").alias("text"))
    p = arts.select(*key, F.explode("paragraphs").alias("p"))
    para = p.filter("p.para_no is not null").select(*key, F.lit("PARAGRAPH").alias("level"), F.col("p.para_no").alias("para_no"), none.alias("item_no"), none.alias("subitem_no"), F.col("p.text").alias("text"))
    i = p.select(*key, F.col("p.para_no").alias("para_no"), F.explode("p.items").alias("i"))
    item = i.select(*key, F.lit("ITEM").alias("level"), "para_no", F.col("i.item_no").alias("item_no"), none.alias("subitem_no"), F.col("i.text").alias("text"))
    s = i.select(*key, "para_no", F.col("i.item_no").alias("item_no"), F.explode("i.subitems").alias("s"))
    sub = s.select(*key, F.lit("SUBITEM").alias("level"), "para_no", "item_no", F.col("s.subitem_no").alias("subitem_no"), F.col("s.text").alias("text"))
    return art.unionByName(para).unionByName(item).unionByName(sub)


def chapter_texts(arts: DataFrame, all_units: DataFrame) -> DataFrame:
    """law_id, chapter_id, text: a chapter's articles with what stands under them, in order."""
    order = F.concat_ws("|", *[F.lpad(F.coalesce(F.col(c), F.lit("")), 8, "0") for c in ("para_no", "item_no", "subitem_no")])
    per = all_units.groupBy("law_id", "article_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "text"))), lambda u: u["text"]), "\n").alias("body"))
    n = F.regexp_extract("article_id", r"(\d+)", 1).try_cast("int")
    joined = arts.select("law_id", "chapter_pos", "chapter_id", "article_id").join(per, ["law_id", "article_id"]).withColumn("_n", n)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "article_id", "body"))), lambda u: u["body"]), "\n")
    return joined.groupBy("law_id", "chapter_pos", "chapter_id").agg(F.concat(F.lit("[CHAPTER] "), F.col("chapter_id"), F.lit("\n"), body).alias("text"))


def provision_text(refs: DataFrame, all_units: DataFrame, key: str) -> DataFrame:
    """refs (key, law_id, article_id, para_no, item_no, subitem_no) with the text of the deepest part that exists, and its level."""
    deep = {"ARTICLE": 0, "PARAGRAPH": 1, "ITEM": 2, "SUBITEM": 3}
    rank = F.coalesce(*[F.when(F.col("u.level") == k, v) for k, v in deep.items()])
    fits = None
    for c in ("para_no", "item_no", "subitem_no"):
        ok = F.col(f"u.{c}").isNull() | F.col(f"u.{c}").eqNullSafe(F.col(f"r.{c}"))
        fits = ok if fits is None else fits & ok
    j = refs.alias("r").join(all_units.alias("u"), (F.col("r.law_id") == F.col("u.law_id")) & (F.col("r.article_id") == F.col("u.article_id")) & fits, "left")
    best = F.max(F.struct(rank.alias("k"), F.col("u.level").alias("level"), F.substring("u.text", 1, 2000).alias("text"))).alias("b")
    return j.groupBy(F.col(f"r.{key}").alias(key)).agg(best).select(key, F.col("b.level").alias("level"), F.col("b.text").alias("text"))


def resolve_references(refs: DataFrame, versions: DataFrame, all_units: DataFrame) -> DataFrame:
    """refs (id, target, citing_law, day) resolved: law, version, provision's level and text, or the reason why not.

    versions: law_name, effective_at, version_key. One plan: parse, as-of lookup by law, provision lookup by version.
    Every reference is resolved, whatever other references share its target.
    """
    inner = x.internal_target(F.col("target"), F.col("citing_law"))
    whole = F.when(inner.isNotNull(), F.concat(inner, F.lit(" "), F.regexp_extract("target", r"(제\s*\d+\s*조.*)$", 1))).otherwise(F.col("target"))
    p = refs.withColumn("_p", x.parse_target(whole)).withColumn("_law", F.col("_p.law"))
    asks = p.select("id", F.col("_law").alias("law_name"), "day", F.col("_p.article_id").alias("article_id"), F.col("_p.paragraph").alias("para_no"), F.col("_p.item").alias("item_no"), F.col("_p.sub_item").alias("subitem_no"))
    dated = asof_or_oldest(asks.filter("law_name is not null"), versions, "law_name", "day", "effective_at", "version_key")
    found = provision_text(dated.filter("version_no is not null").withColumn("law_id", F.col("version_no")), all_units, "id")
    out = asks.select("id", "law_name", "article_id").join(dated.select("id", "version_no", "fallback"), "id", "left").join(found, "id", "left")
    reason = F.when(F.col("article_id").isNull(), "no_pattern").when(F.col("version_no").isNull(), "no_version").when(F.col("text").isNull(), "not_found")
    return out.select("id", "law_name", "article_id", F.col("version_no").alias("version_key"), "fallback", "level", "text", reason.alias("reason"))


def unresolved(targets: DataFrame, versions: DataFrame, laws: DataFrame) -> DataFrame:
    """Targets without a resolved version: target, law_id, version_key, effective, law_name.

    targets: target, law_id, version_key (DAY_NUMBER), resolved_version_key; versions: law_id, version_key, effective;
    laws: law_id, law_name. Neither a version nor a law need be there; without a version the key's own day stands.
    """
    left = targets.filter("resolved_version_key is null").drop("resolved_version_key")
    found = left.join(versions.select("law_id", "version_key", "effective"), ["law_id", "version_key"], "left").join(laws, "law_id", "left")
    return found.withColumn("effective", F.coalesce("effective", F.split("version_key", "_")[0]))


def current_addenda(addenda: DataFrame, laws: DataFrame) -> DataFrame:
    """The units (exploded) of the addenda that belong to a law's current promulgation number, leading zeros apart.

    addenda: law_id, promulgation_no, units (array of structs) and further columns; laws: law_id, current_no.
    """
    plain = lambda c: F.ltrim(F.trim(F.col(c)), F.lit("0"))
    own = addenda.join(laws, "law_id").filter(plain("promulgation_no") == plain("current_no"))
    return own.select(*[c for c in addenda.columns if c != "units"], F.inline("units"))


def cross_law_impact(changed: DataFrame, versions: DataFrame) -> DataFrame:
    """Changed laws (law_name) with each law they touch and its newest version."""
    linked = changed.withColumn("linked", F.explode(x.lookup_list(F.col("law_name"), x.CROSS_LAW)))
    newest = latest_per_group(versions, ["law_name"], "effective_at", "version_key").select(F.col("law_name").alias("linked"), "version_key")
    return linked.join(newest, "linked", "left").select("law_name", "linked", "version_key")


def external_targets(targets: DataFrame, owned: DataFrame, column: str = "target") -> DataFrame:
    """law_name, n: how often other laws are cited, most first, without the laws at hand."""
    counts = targets.select(x.law_name(F.col(column)).alias("law_name")).filter("law_name is not null").groupBy("law_name").agg(F.count("*").alias("n"))
    return counts.join(owned.select("law_name").distinct(), "law_name", "left_anti").orderBy(F.col("n").desc(), "law_name")


def headings(lines: DataFrame, law: str = "law_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """Lines of a statute with the chapter, section and subdivision they stand under; CH_0 before the first chapter."""
    from .segment import carry

    kind = x.unit_kind(F.col(text))
    no = lambda u: x.unit_no(F.col(text), u)
    levels = {"chapter": F.when(kind == "chapter", no("장")), "section": F.when(kind == "section", no("절")), "subdivision": F.when(kind == "subdivision", no("관"))}
    return carry(lines.withColumn("kind", kind), law, [pos], levels).withColumn("chapter", F.coalesce("chapter", F.lit("CH_0")))


def number_of_annexes(annexes: DataFrame) -> DataFrame:
    """version_key, base, parts, role, description, articles: annex parts as one; majority role, first description."""
    a = annexes.withColumn("_a", x.annex_parts(F.col("annex_id"))).select("version_key", F.col("_a.base").alias("base"), F.col("_a.part").alias("part"), "role", "description", "articles")
    roles = a.groupBy("version_key", "base", "role").agg(F.count("*").alias("n")).groupBy("version_key", "base").agg(F.max(F.struct("n", "role")).alias("m"))
    first = F.try_element_at(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("part", "description"))), lambda u: u["description"]), lambda d: F.coalesce(F.trim(d), F.lit("")) != ""), F.lit(1))
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("articles"))))
    body = a.groupBy("version_key", "base").agg(F.count("*").alias("parts"), first.alias("description"), every.alias("articles"))
    return body.join(roles, ["version_key", "base"]).select("version_key", "base", "parts", F.col("m.role").alias("role"), "description", "articles")


def ranked_article(units_: DataFrame, number: str) -> DataFrame:
    """The text of an article by its number (12, 12의2, 제12조의2), one row a law.

    A unit whose heading begins with the number and a bracket comes before one that merely has the number; the latter
    counts only for a number without sub-number, and not if its heading names one.
    """
    base, _, sub = number.strip().removeprefix("제").replace("조", "").partition("의")
    heading = F.col("text").startswith(f"제{base}조{'의' + sub if sub else ''}(")
    plain = F.lit(not sub) & (F.col("article_id") == f"ART_{base}") & ~F.col("text").rlike(r"^제\d+조의\d+")
    r = units_.withColumn("_k", F.when(heading, 1).when(plain, 2)).filter("_k is not null")
    w = Window.partitionBy("law_id").orderBy("_k", "article_id", "level")
    return r.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_k", "_r")


def find_articles(laws: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (law_id, article_id) with the article of that id, wherever in the law it stands, and the chapter; null where there is none.

    laws: law_id, chapters (nested, one row a law). Articles of a chapter come before those of its sections; an article
    that stands twice is found once. Laws are searched in place: only the article asked for leaves its row.
    """
    of = lambda c: F.concat(c["articles"], F.flatten(F.transform(c["sections"], lambda s: s["articles"])))
    held = F.flatten(F.transform("chapters", lambda c: F.transform(of(c), lambda a: F.struct(c["id"].alias("chapter_id"), a.alias("article")))))
    wanted = asks.select("law_id", "article_id").distinct()
    listed = wanted.groupBy("law_id").agg(F.collect_set("article_id").alias("_ids"))
    hits = laws.join(listed, "law_id").select("law_id", F.posexplode(F.filter(held, lambda h: F.array_contains("_ids", h["article"]["id"]))).alias("_k", "_h"))
    first = hits.groupBy("law_id", F.col("_h.article.id").alias("article_id")).agg(F.min_by("_h", "_k").alias("_h"))
    return wanted.join(first, ["law_id", "article_id"], "left").select("law_id", "article_id", F.col("_h.chapter_id").alias("chapter_id"), F.col("_h.article").alias("article"))


def chapter_list(laws: DataFrame) -> DataFrame:
    """law_id, chapter_id: each law's chapters, each once."""
    return laws.select("law_id", F.explode(F.transform("chapters", lambda c: c["id"])).alias("chapter_id")).distinct()
