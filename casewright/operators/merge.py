"""Merging of partial results, enrichment joins, upserts and incremental indexes.

Tables are merged as keyed full joins or unions with anti joins: source and target are each shuffled once by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_list(order: list[str], value: str) -> Column:
    """Aggregate: the values in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])


def merge_lists(df: DataFrame, keys: list[str], order: list[str], lists: list[str], distinct: bool = True) -> DataFrame:
    """Concatenates each group's lists in order, each value once where it first comes (or all of them)."""
    aggs = []
    for c in lists:
        flat = F.flatten(F.filter(ordered_list(order, c), lambda x: x.isNotNull()))
        aggs.append((F.array_distinct(flat) if distinct else flat).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))).filter("_r = 1").drop("_r")


def map_first_wins(df: DataFrame, path: str, root: str, pattern: str, order: list[str]) -> DataFrame:
    """key (extracted from the path, trimmed and in lower case) and the first row that has it, of paths under ``root``."""
    d = df.filter(F.col(path).startswith(root)).withColumn("key", F.lower(F.trim(F.regexp_extract(path, pattern, 1))))
    return first_wins(d.filter("key <> ''"), ["key"], order)


def rename_keys(df: DataFrame, key: str, renamed: Column, order: list[str]) -> DataFrame:
    """Rows under their new keys; where keys meet, a row that had the key already stays, else the first in order."""
    d = df.withColumn("_new", renamed).withColumn("_moved", F.col("_new") != F.col(key))
    return first_wins(d, ["_new"], ["_moved", *order]).withColumn(key, F.col("_new")).drop("_new", "_moved")


def append_text(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Texts of each group one under the other, leaving out those that the text so far already holds."""
    parts = F.filter(ordered_list(order, text), lambda x: x.isNotNull() & (F.trim(x) != ""))
    fold = F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x).when(a.contains(x), a).otherwise(F.concat(a, F.lit("\n"), x)))
    return df.groupBy(*keys).agg(fold.alias(text))


def enrich(units: DataFrame, tags: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Units with the tags of the same key, where a null key part equals null; defaults where a unit has none."""
    t = tags.select(*[F.col(k).alias(f"_{k}") for k in keys], *defaults)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = units.join(t, on, "left").drop(*[f"_{k}" for k in keys])
    return out.withColumns({c: F.coalesce(F.col(c), d if isinstance(d, Column) else F.lit(d)) for c, d in defaults.items()})


def positional(lists: DataFrame, key: str, array: str, refs: DataFrame, position: str, value: str) -> DataFrame:
    """refs with the array element at their position, counted from 1; null where there is none."""
    one = lists.select(key, F.posexplode(array).alias("_p", value)).withColumn(position, F.col("_p") + 1).drop("_p")
    return refs.join(one, [key, position], "left")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Target with the source's rows in place of those of the same key; ``keep`` columns stay as the target has them."""
    s = source.withColumns({c: F.col(c) for c in source.columns})
    joined = target.alias("t").join(s.alias("s"), [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full")
    there = F.coalesce(*[F.col(f"s.{k}").isNotNull() for k in keys]) if len(keys) == 1 else F.greatest(*[F.col(f"s.{k}").isNotNull() for k in keys])
    out = []
    for c in target.columns:
        if c in keep:
            out.append(F.coalesce(f"t.{c}", f"s.{c}").alias(c))
        else:
            out.append(F.when(there, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return joined.select(*out)


def overwrite_by_key(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key the source lacks, and all source rows."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def delete_keys(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Target rows whose key is not listed."""
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def update_where(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Target with some columns set from the changes of the same key."""
    c = changes.select(*keys, *[F.col(x).alias(f"_{x}") for x in columns]).withColumn("_hit", F.lit(True))
    out = target.join(c, keys, "left")
    return out.withColumns({x: F.when(F.col("_hit"), F.col(f"_{x}")).otherwise(F.col(x)) for x in columns}).drop("_hit", *[f"_{x}" for x in columns])


def reset(target: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """Sets columns to null where the condition holds."""
    return target.withColumns({c: F.when(condition, F.lit(None)).otherwise(F.col(c)) for c in columns})


def digest(*columns: str) -> Column:
    """SHA-256 over columns, null and empty told apart."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]), 256)


def incremental(index: DataFrame, cases: DataFrame, key: str, digest_column: str, build) -> DataFrame:
    """Index rows after a run over the cases: unchanged and vanished cases keep theirs, the others' are built anew.

    index: key, digest and payload columns; cases: key, digest and inputs; build: cases -> rows like the index.
    """
    known = index.select(key, F.col(digest_column).alias("_d")).distinct()
    changed = cases.join(known, key, "left").filter(~F.col(digest_column).eqNullSafe(F.col("_d"))).drop("_d")
    rebuilt = build(changed)
    return index.join(changed.select(key), key, "left_anti").unionByName(rebuilt)


def complete_cases(stages: DataFrame, case: str, stage: str, required: list[str]) -> DataFrame:
    """Cases that have every required stage."""
    return stages.filter(F.col(stage).isin(required)).groupBy(case).agg(F.count_distinct(stage).alias("n")).filter(F.col("n") == len(required)).select(case)


def drop_incomplete(stages: DataFrame, case: str, stage: str, raw: list[str], required: list[str]) -> DataFrame:
    """Without the derived rows of incomplete cases; raw stages stay."""
    done = complete_cases(stages, case, stage, required).withColumn("_done", F.lit(True))
    return stages.join(done, case, "left").filter(F.col(stage).isin(raw) | F.col("_done")).drop("_done")


def first_available(stages: DataFrame, case: str, stage: str, order: list[str]) -> DataFrame:
    """Each case's row of the first stage in order that it has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(stage))
    ranked = stages.withColumn("_k", rank).filter("_k > 0")
    return first_wins(ranked, [case], ["_k"]).drop("_k")
