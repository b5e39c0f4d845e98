"""Nested case reports and inputs of later steps as flat rows: issues, chains, sections, narratives, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import char_chunks


def core_issues(reports: DataFrame, case: str, issues: str = "issues") -> DataFrame:
    """case, issue_no (from 1), title, chains, statutes: the issues of each report, and the statutes (each once) that it cites.

    issues: array of title, chains (array of strings), citations (array of source_type, ref).
    """
    i = reports.select(case, F.posexplode(issues).alias("_p", "i"))
    statutes = F.array_distinct(F.transform(F.filter("i.citations", lambda c: c["source_type"] == "statute"), lambda c: c["ref"]))
    return i.select(case, (F.col("_p") + 1).alias("issue_no"), F.col("i.title").alias("title"), F.col("i.chains").alias("chains"), statutes.alias("statutes"))


def embed_inputs(cases: DataFrame, case: str, fact: str, chains: str, most: int = 500) -> DataFrame:
    """key (case:chain), text: one for each chain of a case, with the beginning of the case's facts under it; blank chains have none."""
    c = cases.select(case, fact, F.posexplode(chains).alias("_p", "_c")).filter(F.trim("_c") != "")
    return c.select(F.concat_ws(":", F.col(case).cast("string"), F.col("_p") + 1).alias("key"), F.concat_ws("\n", "_c", F.substring(fact, 1, most)).alias("text"))


def sections(df: DataFrame, key: str, groups: str) -> DataFrame:
    """key, title, items: a map of groups as rows, by title; the group's name becomes the title."""
    entries = F.array_sort(F.map_entries(groups))
    return df.select(key, F.explode(entries).alias("e")).select(key, F.col("e.key").alias("title"), F.col("e.value").alias("items"))


def narratives(df: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """key, label, text: one row for each named part that is not blank."""
    every = F.array(*[F.struct(F.lit(k).alias("label"), c.cast("string").alias("text")) for k, c in parts.items()])
    return df.select(key, F.inline(every)).filter(F.coalesce(F.trim("text"), F.lit("")) != "")


def observations(df: DataFrame, key: str, kind: str, text: str, kinds: dict[str, str], size: int) -> DataFrame:
    """id, kind, title, text: rows of a known kind with key and text, cut to ``size`` characters; parts are numbered _1, _2, ...

    kinds maps the kinds of the source to those of the observations; rows of other kinds, without key or without text go.
    """
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    good = df.select(F.col(key).cast("string").alias("_id"), names[F.col(kind)].alias("kind"), F.col(text).alias("text")).filter("_id is not null and kind is not null and trim(coalesce(text, '')) <> ''")
    cut = char_chunks(good.withColumn("_n", F.ceil(F.length("text") / size)), ["_id", "kind", "_n"], "text", size)
    many = F.col("_n") > 1
    return cut.select(F.when(many, F.concat_ws("_", "_id", "part")).otherwise(F.col("_id")).alias("id"), "kind", F.concat(F.initcap("kind"), F.when(many, F.concat(F.lit(" (part "), "part", F.lit(")"))).otherwise("")).alias("title"), "text")
