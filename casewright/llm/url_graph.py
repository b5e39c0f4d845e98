"""URL filters: fixed rules first, then trust and distrust that spread over the hosts' links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import drop, stage

#: (prefix of host and path, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> F.Column:
    """What stands after the first :// up to / ? # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url) -> F.Column:
    """What stands after the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict; null where none fits. A rule holds for its host and all subdomains."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: -len(r[0])):
        cut = text.index("/")
        fits = ((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts, counted: src, dst, n. Links without a host stay within theirs and count for nothing."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("url"))
    return links.select("src", host_of(F.col("url")).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def shares(edges: DataFrame, end: str, other: str, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Links along which rank flows (src, part, dst, share of src's links), and the hosts (src, parts) of over ``most`` links, whose links are dealt into parts."""
    of = edges.groupBy(F.col(end).alias("src")).agg(F.sum("n").alias("of"), F.ceil(F.count("*") / most).cast("int").alias("parts"))
    flow = edges.select(F.col(end).alias("src"), F.col(other).alias("dst"), "n").join(of, "src")
    flow = stage(flow.select("src", F.pmod(F.xxhash64("dst"), "parts").cast("int").alias("part"), "dst", (F.col("n") / F.col("of")).alias("share")), "url-flow")
    return flow, stage(of.filter("parts > 1").select("src", "parts"), "url-hubs")


def spread(seeds: DataFrame, flow: DataFrame, hubs: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank: host, rank. seeds: host, mass (any scale); flow and hubs: see shares().

    What the seeds send is followed link by link: each round carries on what the last one brought, ``damping`` times, and
    is written to the shared folder, until less than ``tolerance`` of the seeds' mass is on its way (about 85 rounds where
    every host has links). The ranks are all that was brought, scaled to 1: what reaches hosts without links goes back to
    the seeds. Only hosts that something reaches take part in a round, and a hub sends to each part of its links.
    """
    total = seeds.agg(F.sum("mass")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank"))
    seeds = stage(seeds.select("host", (F.col("mass") / F.lit(float(total))).alias("rank")), "url-rank")
    rounds, moving, some = [seeds], 1.0, not hubs.isEmpty()
    while moving >= tolerance:
        at = rounds[-1].withColumnRenamed("host", "src")
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)) if some else F.lit(0)
        at = (at.join(hubs, "src", "left") if some else at).withColumn("part", parts)
        sent = at.join(flow, ["src", "part"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"))
        told = Observation()
        rounds.append(stage(sent.observe(told, F.coalesce(F.sum("rank"), F.lit(0.0)).alias("moving")), "url-rank"))
        moving = told.get["moving"]
    brought = seeds.sparkSession.read.schema(seeds.schema).parquet(*(r.staged_path for r in rounds)).groupBy("host").agg(F.sum("rank").alias("rank"))
    ranks = stage(brought, "url-ranks")
    drop(*rounds)
    whole = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select("host", (F.col("rank") / F.lit(float(whole))).alias("rank"))


def judge(pages: DataFrame, rules=RULES, margin: float = 1.0) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict, trust, distrust.

    Seeds are the hosts of pages that rules allow or block, each with its number of such pages, so a host with pages of
    both kinds is judged by whether it holds more of all blocked or of all allowed pages. Trust follows links from
    trusted hosts; distrust runs against the links, from blocked hosts to those that link to them. Where no rule fits, a
    host is blocked if its distrust exceeds ``margin`` times its trust, and allowed otherwise, as are pages without a
    host or with no evidence. Null urls and html count as empty; repeated pages are judged each; pages are read whole, of
    any length; an empty table gives an empty result; further columns do not matter, whatever their names.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("by_rule", verdict)
    counts = stage(judged.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count("*").alias("pages")), "url-hosts")
    edges = stage(host_edges(pages), "url-edges")
    trust = spread(counts.filter("allowed > 0").select("host", F.col("allowed").cast("double").alias("mass")), *shares(edges, "src", "dst")).select("host", F.col("rank").alias("trust"))
    distrust = spread(counts.filter("blocked > 0").select("host", F.col("blocked").cast("double").alias("mass")), *shares(edges, "dst", "src")).select("host", F.col("rank").alias("distrust"))
    hosts = stage(counts.select("host").join(trust, "host", "left").join(distrust, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "url-verdicts")
    by_method = F.when(F.col("distrust") > margin * F.col("trust"), "block").otherwise("allow")
    return judged.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``pages`` table."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
