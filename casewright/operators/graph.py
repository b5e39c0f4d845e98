"""Traversals over node and edge tables as keyed joins. Optional branches are left joins, collected without a product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.sources.shared import written


def hop(nodes: DataFrame, edges: DataFrame, on: list[str] | str, optional: bool = False) -> DataFrame:
    """One step along edges; with ``optional`` nodes without edges stay."""
    return nodes.join(edges, on, "left" if optional else "inner")


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is one of the ids."""
    return df.join(ids, key, "left_semi")


def collect_optional(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Each parent with its children, joined in order by commas; empty where it has none.

    Children are reduced by parent before the join, so several optional branches never multiply each other.
    """
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda x: x[order[-1]].cast("string")), ",")
    grouped = children.groupBy(key).agg(listed.alias(name), F.count("*").alias(f"n_{name}"))
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.lit(""))).withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))


def node_set(parts: list[DataFrame]) -> DataFrame:
    """Nodes id, kind, name of several projections, each id once (the first projection's wins)."""
    named = [p.select(F.col("id").cast("string").alias("id"), "kind", "name").withColumn("_p", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b), named)
    return every.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("_p", "name"))).filter("_r = 1").drop("_r", "_p")


def edge_list(parts: list[DataFrame]) -> DataFrame:
    """Edges src, dst, kind of several projections; none is dropped."""
    return reduce(lambda a, b: a.unionByName(b), [p.select("src", "dst", "kind") for p in parts])


def link_or_fallback(citations: DataFrame, targets: DataFrame, on: list[str], found: str, fallback: Column) -> DataFrame:
    """Each citation with the target it names or, where there is none, a fallback; ``linked_to`` says which."""
    t = targets.select(*on).distinct().withColumn("_there", F.lit(True))
    out = citations.join(t, on, "left")
    return out.withColumn("linked_to", F.when(F.col("_there"), F.lit(found)).otherwise(fallback)).drop("_there")


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id, depth: everything under each root, to any depth, with the root itself at depth 0.

    edges: parent, child of a containment hierarchy (each child has one parent); roots: root. Each level joins what the
    last one found with the edges and is written, until a level finds nothing. The job fails where a child is its own root.
    """
    level = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"))
    found = [written(level, "under")]
    while True:
        below = found[-1].join(edges, F.col("id") == F.col("parent")).select("root", F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"))
        cycle = F.raise_error(F.concat(F.lit("a cycle leads back to "), F.col("root").cast("string"))).cast("boolean")
        level = written(below.filter(F.when(F.col("id") == F.col("root"), cycle).otherwise(True)), "under")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(level)


def chain_sorted(start: DataFrame, *steps: tuple[DataFrame, list[str] | str]) -> DataFrame:
    """Inner joins one after the other: a path of fixed length."""
    return reduce(lambda a, s: a.join(s[0], s[1]), steps, start)


def spread_scopes(snapshots: DataFrame, key: str, scopes: dict[str, str]) -> DataFrame:
    """One row for each scope of a snapshot that has one: key, scope, version; scopes: name -> column."""
    parts = F.array(*[F.struct(F.lit(n).alias("scope"), F.lit(i).alias("scope_rank"), F.col(c).alias("version")) for i, (n, c) in enumerate(scopes.items())])
    return snapshots.select(key, F.inline(parts)).filter("version is not null")
