"""Versions in time: validity windows, as-of lookups, overlap of several lanes, change points, deadlines.

Windows are half open, [valid_from, valid_to), and a null valid_to is open. All of it is keyed: windows and joins are
partitioned by the family of versions, so plans hold no nested loops and no task holds more than a family.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def far() -> Column:
    """The end of an open window, for comparisons."""
    return F.lit("9999-12-31").cast("date")


def parse_date(text: Column) -> Column:
    """A date from 8 digits, with or without . - /, or from 6 digits (the month's first day); null otherwise."""
    digits = F.regexp_replace(F.trim(text), r"[-./\s]", "")
    digits = F.when(digits.rlike(r"^\d{6}$"), F.concat(digits, F.lit("01"))).otherwise(digits)
    return F.when(digits.rlike(r"^\d{8}$"), F.try_to_date(digits, "yyyyMMdd"))


def latest_per_group(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each group that is greatest by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def version_windows(versions: DataFrame, keys: list[str], start: str = "effective_at", no: str = "no") -> DataFrame:
    """Windows of each lane's versions; of versions effective on one day the one with the largest number stands."""
    one = versions.groupBy(*keys, start).agg(F.max(no).alias(no))
    after = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return one.select(*keys, no, F.col(start).alias("valid_from"), after.alias("valid_to"))


def covers(day: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether a window holds a day."""
    return (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day))


def in_force(day: Column, effective: str, abolished: str) -> Column:
    """Effective at ``day`` and not abolished by then."""
    return (F.col(effective) <= day) & (F.col(abolished).isNull() | (F.col(abolished) > day))


def effective_version(windows: DataFrame, keys: list[str], day: str, no: str = "no") -> DataFrame:
    """Each lane's version in force on a day: the latest start, then the largest number."""
    found = windows.filter(covers(F.lit(day).cast("date")))
    return found.groupBy(*keys).agg(F.max(F.struct("valid_from", no, "valid_to")).alias("v")).select(*keys, "v.*")


def meet(*windows: tuple[Column, Column]) -> tuple[Column, Column]:
    """Start and end of what several windows share (empty if start >= end; a null end is open)."""
    start = F.greatest(*[w[0] for w in windows])
    end = F.least(*[F.coalesce(w[1], far()) for w in windows])
    return start, F.nullif(end, far())


def overlap_join(lanes: dict[str, DataFrame], key: str, no: str = "no") -> DataFrame:
    """One row for each combination of one version of every lane whose windows share a day, with the shared window."""
    named = [w.select(key, F.col(no).alias(f"{n}_no"), F.col("valid_from").alias(f"{n}_from"), F.col("valid_to").alias(f"{n}_to")) for n, w in lanes.items()]
    joined = reduce(lambda a, b: a.join(b, key), named)
    start, end = meet(*[(F.col(f"{n}_from"), F.col(f"{n}_to")) for n in lanes])
    joined = joined.select(key, *[f"{n}_no" for n in lanes], start.alias("valid_from"), end.alias("valid_to"))
    return joined.filter(F.col("valid_from") < F.coalesce("valid_to", far()))


def change_points(versions: DataFrame, key: str, lane: str, lanes: dict[str, str], start: str = "effective_at", no: str = "no") -> DataFrame:
    """Snapshots of all lanes at every day on which one changes, from the first day on which all exist.

    lanes: name -> value of the lane column. One pass over the versions sorted by family and day; no lane is joined.
    """
    days = versions.groupBy(key, start).agg(*[F.max(F.when(F.col(lane) == v, F.col(no))).alias(n) for n, v in lanes.items()])
    upto = Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(key, F.col(start).alias("valid_from"), *[F.last(n, ignorenulls=True).over(upto).alias(f"{n}_no") for n in lanes])
    days = days.filter(reduce(lambda a, b: a & b, [F.col(f"{n}_no").isNotNull() for n in lanes]))
    after = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    return days.withColumn("valid_to", after).select(key, *[f"{n}_no" for n in lanes], "valid_from", "valid_to")


def first_of_set(snapshots: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Of snapshots with equal parts the first, with windows up to the next one that is left."""
    rank = F.row_number().over(Window.partitionBy(key, *parts).orderBy("valid_from"))
    kept = snapshots.withColumn("_r", rank).filter("_r = 1").drop("_r")
    return kept.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from")))


def set_key(parts: dict[str, Column]) -> Column:
    """NAME_part__NAME_part...: one string for a combination of versions."""
    return F.concat_ws("__", *[F.concat_ws("_", F.lit(n), c) for n, c in parts.items()])


def part_of_set_key(key: Column, name: str) -> Column:
    """A part of a set key; null if it has none of that name."""
    return F.nullif(F.regexp_extract(key, rf"(?:^|__){name}_(.*?)(?:__|$)", 1), F.lit(""))


def prior_version(versions: DataFrame, keys: list[str], start: str = "effective_at", no: str = "no") -> DataFrame:
    """Each version with the last one strictly before its day (the largest number of that day), or a note that none is."""
    before = Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    days = versions.groupBy(*keys, start).agg(F.max(no).alias("_n"))
    days = days.withColumn("_prior", F.max(F.struct(start, "_n")).over(before)).drop("_n")
    out = versions.join(days, [*keys, start])
    return out.select(*keys, no, start, F.col(f"_prior.{start}").alias("prior_at"), F.col("_prior._n").alias("prior_no"), F.when(F.col("_prior").isNull(), "no earlier version").alias("note"))


def asof_or_oldest(asks: DataFrame, versions: DataFrame, key: str, day: str, start: str = "effective_at", no: str = "no") -> DataFrame:
    """Each ask with the version in force on its day or, where none is yet, the oldest (fallback true).

    Asks and versions are merged into one line per family, so the plan has one shuffle by family and no join.
    """
    v = versions.groupBy(key, start).agg(F.max(no).alias(no))
    line = v.select(key, F.col(start).alias("_day"), F.lit(0).alias("_ask"), F.struct(F.col(start).alias("at"), F.col(no).alias("no")).alias("_v"), *[F.lit(None).cast(t).alias(c) for c, t in asks.dtypes if c != key])
    line = line.unionByName(asks.select(key, F.col(day).alias("_day"), F.lit(1).alias("_ask"), F.lit(None).cast(line.schema["_v"].dataType).alias("_v"), *[c for c in asks.columns if c != key]))
    upto = Window.partitionBy(key).orderBy("_day", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_now", F.last("_v", ignorenulls=True).over(upto)).withColumn("_old", F.min("_v").over(Window.partitionBy(key)))
    out = line.filter("_ask = 1").withColumn("_got", F.coalesce("_now", "_old"))
    return out.select(*asks.columns, F.col("_got.at").alias("version_at"), F.col("_got.no").alias("version_no"), (F.col("_now").isNull() & F.col("_old").isNotNull()).alias("fallback"))


def append_unseen(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target and those source rows whose key it lacks; existing rows stay as they are."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def new_ids(remote: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of remote rows that local ones lack."""
    return remote.select(*keys).distinct().join(local.select(*keys), keys, "left_anti")


def deadlines(cases: DataFrame, notice: str, as_of: str, days: int = 90) -> DataFrame:
    """Cases with the deadline, the days passed, whether it is overdue, and the days left, on a given day."""
    day = F.lit(as_of).cast("date")
    due = F.date_add(notice, days)
    return cases.withColumn("deadline", due).withColumn("elapsed", F.datediff(day, notice)).withColumn("overdue", due < day).withColumn("left", F.greatest(F.datediff(due, day), F.lit(0)))


def route_versions(cites: DataFrame, snapshots: DataFrame, index: DataFrame) -> DataFrame:
    """Citations of prior versions with a promulgation number: version, route (snapshot, index or model).

    cites: is_prior_version, promulgation_no, family, law and keys; snapshots: family, promulgation_no, version; index:
    law, promulgation_no, version. A family's snapshot comes first, then the local index; what neither has is for a model.
    """
    c = cites.filter(F.col("is_prior_version") & F.col("promulgation_no").isNotNull())
    s = snapshots.select("family", "promulgation_no", F.col("version").alias("_s"))
    i = index.select("law", "promulgation_no", F.col("version").alias("_i"))
    j = c.join(s, ["family", "promulgation_no"], "left").join(i, ["law", "promulgation_no"], "left")
    route = F.when(F.col("_s").isNotNull(), "snapshot").when(F.col("_i").isNotNull(), "index").otherwise("model")
    return j.withColumns({"version": F.coalesce("_s", "_i"), "route": route}).drop("_s", "_i")


def checked_windows(windows: DataFrame, golden: DataFrame, keys: list[str]) -> DataFrame:
    """The windows; the job fails at the first one that differs from its golden window, or that a golden one lacks, and names it.

    windows and golden: keys, valid_from, valid_to (null: open). Keys without a golden window are not checked.
    """
    g = golden.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.lit(True).alias("_gold"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    j = windows.withColumn("_there", F.lit(True)).join(g, on, "full")
    same = F.col("valid_from").eqNullSafe(F.col("_from")) & F.col("valid_to").eqNullSafe(F.col("_to"))
    named = F.concat_ws(", ", *[F.coalesce(F.col(k), F.col(f"_g_{k}")).cast("string") for k in keys])
    wrong = F.raise_error(F.concat(F.lit("window of "), named, F.when(F.col("_there").isNull(), F.lit(" is missing")).otherwise(F.lit(" differs from the golden one"))))
    return j.filter(F.when(F.col("_gold").isNull() | (F.col("_there").isNotNull() & same), F.lit(True)).otherwise(wrong.cast("boolean"))).select(*windows.columns)
