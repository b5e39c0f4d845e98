"""Nested laws changed in place: tags set at every level of a hierarchy, parts merged in order, edges and lookups that need all their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.sources.versioned import VersionedTable

from .merge import ordered_list

CROSS_REFS = "array<struct<type:string,target:string,note:string>>"


def _path(*parts: Column) -> Column:
    """A part's place in its article: the numbers down to it, with a mark for a number that is missing; '' for the article itself."""
    return F.array_join(F.array(*[F.coalesce(p, F.lit("~")) for p in parts]), "|") if parts else F.lit("")


def article_paths(article: Column) -> Column:
    """array<struct<level, ref>> of an article and all parts under it, from the top down."""
    one = lambda level, *parts: F.struct(F.lit(level).alias("level"), _path(*parts).alias("ref"))
    sub = lambda p, i: F.transform(F.coalesce(i["subitems"], F.array().cast("array<struct<subitem_no:string,text:string>>")), lambda s: one("SUBITEM", p["para_no"], i["item_no"], s["subitem_no"]))
    item = lambda p: F.flatten(F.transform(p["items"], lambda i: F.concat(F.array(one("ITEM", p["para_no"], i["item_no"])), sub(p, i))))
    para = F.flatten(F.transform(article["paragraphs"], lambda p: F.concat(F.array(one("PARAGRAPH", p["para_no"])), F.coalesce(item(p), F.filter(F.array(one("ITEM")), lambda _: F.lit(False))))))
    return F.concat(F.array(one("ARTICLE")), F.coalesce(para, F.filter(F.array(one("ARTICLE")), lambda _: F.lit(False))))


def with_norm_units(laws: DataFrame, norms: DataFrame, refs: DataFrame) -> DataFrame:
    """laws (law_id, chapters) with ``norm_units`` in each article, wherever in the hierarchy it stands.

    norms: law_id, article_id, level, ref, roles, short_label; refs: law_id, article_id, level, ref, cross_refs; ref as in
    article_paths(). Every unit of an article gets a norm unit (level, ref, roles, short_label, cross_refs): empty lists
    and a null label where nothing is known; of several tags of a unit the least counts. Tags are joined once per law, as
    a map by article, and set by nested transforms: no row leaves its law, so order and depth stay as they are.
    """
    keys = ["law_id", "article_id", "level", "ref"]
    label = norms.select(*keys, F.struct("roles", "short_label").alias("n"))
    cited = refs.select(*keys, "cross_refs")
    every = label.withColumn("cross_refs", F.lit(None).cast(cited.schema["cross_refs"].dataType)).unionByName(cited.withColumn("n", F.lit(None).cast(label.schema["n"].dataType)))
    # a law's tags come together once; units, articles and laws are then grouped where they lie
    tag = every.repartition("law_id").groupBy(*keys).agg(F.min("n").alias("n"), F.min("cross_refs").alias("cross_refs")).select(*keys, "n.roles", "n.short_label", "cross_refs")
    by_article = tag.groupBy("law_id", "article_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "level", "ref").alias("k"), F.struct("roles", "short_label", "cross_refs").alias("v")))).alias("tags"))
    by_law = by_article.groupBy("law_id").agg(F.map_from_entries(F.collect_list(F.struct("article_id", "tags"))).alias("_tags"))

    def units(a: Column) -> Column:
        tags = F.col("_tags")[a["id"]]

        def unit(u: Column) -> Column:
            t = tags[F.concat_ws(" ", u["level"], u["ref"])]
            return F.struct(u["level"].alias("level"), u["ref"].alias("ref"), F.coalesce(t["roles"], F.array().cast("array<string>")).alias("roles"), t["short_label"].alias("short_label"), F.coalesce(t["cross_refs"], F.array().cast(CROSS_REFS)).alias("cross_refs"))

        return F.transform(article_paths(a), unit)

    marked = lambda holder: holder.withField("articles", F.transform(holder["articles"], lambda a: a.withField("norm_units", units(a))))
    section_fields = laws.schema["chapters"].dataType.elementType["sections"].dataType.elementType.fieldNames()

    def section(s: Column) -> Column:
        s = marked(s)
        return s.withField("subdivisions", F.transform(s["subdivisions"], marked)) if "subdivisions" in section_fields else s

    chapter = lambda c: marked(c).withField("sections", F.transform(c["sections"], section))
    joined = laws.join(by_law, "law_id", "left")
    return joined.withColumn("chapters", F.transform("chapters", chapter)).drop("_tags")


def merge_addenda(observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, law_type, addenda: a version's addenda as one list by date, undated ones first, and the first one's kind of law.

    observed: keys, addenda_date (YYYYMMDD), law_type, content; equal dates stand by content.
    """
    rows = observed.withColumn("a", F.struct("addenda_date", "content", "law_type"))
    listed = rows.groupBy(*keys).agg(ordered_list(["addenda_date", "content", "law_type"], "a").alias("_l"))
    return listed.select(*keys, F.col("_l")[0]["law_type"].alias("law_type"), F.transform("_l", lambda a: F.struct(a["addenda_date"].alias("date"), a["content"].alias("content"))).alias("addenda"))


def source_chapters(integrated: DataFrame, chapters: DataFrame) -> DataFrame:
    """An edge from each integrated chapter to the law's, decree's and rule's chapter of the same id that exists: set_key, chapter_id, scope, version_key.

    integrated: set_key (LAW_v__DECREE_v__RULE_v; any part may be missing), chapter_id; chapters: scope, version_key, id. One join.
    """
    parts = F.transform(F.split("set_key", "__"), lambda p: F.struct(F.regexp_extract(p, "^([A-Z]+)_(.+)$", 1).alias("scope"), F.regexp_extract(p, "^([A-Z]+)_(.+)$", 2).alias("version_key")))
    asked = integrated.select("set_key", "chapter_id", F.inline(parts)).filter(F.col("scope").isin("LAW", "DECREE", "RULE"))
    there = chapters.select("scope", "version_key", F.col("id").alias("chapter_id")).distinct()
    return asked.join(there, ["scope", "version_key", "chapter_id"]).select("set_key", "chapter_id", "scope", "version_key").distinct()


def required_parts(df: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """The rows; the job fails at one that lacks a part, and says which part of which key. parts: what to call it -> a column that must not be null."""
    lacks = F.array_join(F.array_compact(F.array(*[F.when(c.isNull(), n) for n, c in parts.items()])), ", ")
    fails = F.raise_error(F.concat(lacks, F.lit(" not found for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return df.filter(F.when(lacks == "", F.lit(True)).otherwise(fails.cast("boolean")))


def snapshot_paths(snapshots: DataFrame, index: DataFrame, key: str, scopes: dict[str, str]) -> DataFrame:
    """Snapshots with a path for each scope (law_path, ...), looked up by ``SCOPE:day_number``; a missing one fails the job by name.

    scopes: LAW -> column of day_number; index: key, path. The scopes are looked up by one join, not one each.
    """
    asks = snapshots.select(key, F.inline(F.array(*[F.struct(F.lit(s).alias("scope"), F.concat(F.lit(f"{s}:"), F.col(c)).alias("_k")) for s, c in scopes.items()])))
    found = asks.join(index.select(F.col("key").alias("_k"), "path"), "_k", "left").groupBy(key).agg(*[F.max(F.when(F.col("scope") == s, F.struct("path", "_k"))).alias(s) for s in scopes])
    checked = required_parts(found, key, {f"{s} path": F.col(s)["path"] for s in scopes})
    return checked.select(key, *[F.col(s)["path"].alias(f"{s.lower()}_path") for s in scopes])


def save_once(entries: DataFrame, store: VersionedTable, token: str | None = None) -> int:
    """Adds the entries whose key the store lacks; what is there is never overwritten. Of entries of one key the least is kept."""
    m = store.read().columns
    keys = store.manifest()["keys"]
    rest = [c for c in m if c not in keys]
    one = entries.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_v")).select(*keys, "_v.*")
    return store.merge(one, keep=tuple(m), token=token)

