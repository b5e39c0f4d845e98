"""Outcome rates, facets, counts, quotas, keyword indexes: aggregates that reduce before they shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, total: Column) -> Column:
    """Percentage with one decimal; null for nothing."""
    return F.round(F.try_divide(part * F.lit(100.0), total), 1)


def rate_by(df: DataFrame, group: list[str], win: Column) -> DataFrame:
    """total, wins and win_rate of each group."""
    g = df.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(win).alias("wins"))
    return g.withColumn("win_rate", rate(F.col("wins"), F.col("total")))


def facets(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """facet, value, n, share: counts of every value of several columns, in one pass; the ``limit`` most common of each."""
    values = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]
    g = df.select(F.inline(F.array(*values))).groupBy("facet", "value").agg(F.count("*").alias("n"))
    g = g.withColumn("share", rate(F.col("n"), F.sum("n").over(Window.partitionBy("facet"))))
    if limit is None:
        return g
    order = Window.partitionBy("facet").orderBy(F.col("n").desc(), "value")
    return g.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).drop("_r")


def sample_first(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key: a sample that is the same every time."""
    return df.orderBy(key).limit(n)


def combined_rate(df: DataFrame, column: str, wins: list[str]) -> DataFrame:
    """One row: n, won and the rate of rows whose label is among ``wins`` (exact labels)."""
    g = df.agg(F.count("*").alias("n"), F.count_if(F.col(column).isin(wins)).alias("won"))
    return g.withColumn("win_rate", rate(F.col("won"), F.col("n")))


def rate_sentence(df: DataFrame, win: Column) -> DataFrame:
    """One row with a sentence on the rate of wins."""
    g = df.agg(F.count("*").alias("n"), F.count_if(win).alias("won"))
    return g.select(F.when(F.col("n") == 0, "no cases").otherwise(F.format_string("%d of %d cases won (%s%%)", "won", "n", rate(F.col("won"), F.col("n")).cast("string"))).alias("summary"))


def status_counts(df: DataFrame, group: list[str], statuses: dict[str, Column]) -> DataFrame:
    """total and a count for each named condition."""
    return df.groupBy(*group).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in statuses.items()])


def usage_left(log: DataFrame, user: str, at: str, as_of: str, limit: int = 10) -> DataFrame:
    """used and left of each user since the first of the month of ``as_of``, up to that moment."""
    day = F.lit(as_of).cast("timestamp_ntz")
    recent = log.filter((F.col(at) >= F.date_trunc("month", day).cast("timestamp_ntz")) & (F.col(at) < day))
    return recent.groupBy(user).agg(F.count("*").alias("used")).withColumn("left", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)))


def keyword_signature(words: DataFrame, word: str, doc: str, medium: int = 2, common: int = 5) -> DataFrame:
    """word, docs, bucket: unique (in one document), medium, or common (from ``common`` documents)."""
    g = words.select(word, doc).distinct().groupBy(word).agg(F.count("*").alias("docs"))
    return g.withColumn("bucket", F.when(F.col("docs") < medium, "unique").when(F.col("docs") < common, "medium").otherwise("common"))


def inverted_index(words: DataFrame, word: str, doc: str, part: Column) -> DataFrame:
    """word, part, docs, listed: ascending documents of every word, a frequent word's list in numbered parts.

    part is computed from the document and bounds what one row lists (as in doc / 1000).
    """
    listed = F.sort_array(F.collect_set(doc))
    g = words.groupBy(word, part.alias("part")).agg(listed.alias("_l"))
    return g.select(word, "part", F.size("_l").cast("long").alias("docs"), F.array_join(F.transform("_l", lambda x: x.cast("string")), ",").alias("listed"))


def collected(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The group's values in order, joined by a bar."""
    o = [F.col(c) for c in order]
    pick = F.transform(F.sort_array(F.collect_list(F.struct(*o, value.cast("string").alias("_v")))), lambda x: x["_v"])
    return df.groupBy(*group).agg(F.array_join(pick, "|").alias(name))


def top_values(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value).limit(n)


def majority(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group (ties: the larger one), with its count."""
    g = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return g.groupBy(*group).agg(F.max(F.struct("n", value)).alias("m")).select(*group, f"m.{value}", "m.n")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: rows of each table."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in tables.items()])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def year_in(date: Column, first: int, last: int) -> Column:
    """The year that a date's text begins with, if it is four digits and lies in the range; null otherwise."""
    year = F.when(F.substring(date, 1, 4).rlike("^[0-9]{4}$"), F.substring(date, 1, 4).cast("int"))
    return F.when(year.between(first, last), year)


def yearly_cases(cases: DataFrame, date: str, number: str, win: Column, first: int, last: int, most: int = 1000) -> DataFrame:
    """year, part, total, wins, win_rate, cases: a year's rate and its case numbers by date, at most ``most`` in a part.

    ``date`` is a text; cases whose date begins with no year, or with one out of the range, are left out.
    """
    d = cases.withColumn("year", year_in(F.col(date), first, last)).filter("year IS NOT NULL").withColumn("_w", F.coalesce(win, F.lit(False)))
    totals = rate_by(d, ["year"], F.col("_w"))
    # numbered within a day first, so that no task numbers a year
    days = d.groupBy("year", date).agg(F.count("*").alias("n"))
    ahead = days.withColumn("_ahead", F.sum("n").over(Window.partitionBy("year").orderBy(date)) - F.col("n")).select(date, "_ahead")
    at = F.row_number().over(Window.partitionBy(date).orderBy(number)) - 1 + F.col("_ahead")
    parts = d.join(ahead, date).withColumn("_at", at).withColumn("part", F.floor(F.col("_at") / most).cast("int"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_at", F.col(number).alias("_c")))), lambda x: x["_c"])
    return parts.groupBy("year", "part").agg(listed.alias("cases")).join(totals, "year").select("year", "part", "total", "wins", "win_rate", "cases")


def pattern_lines(cases: DataFrame, statutes: DataFrame, key: str, win: Column, statute: str, top: int = 4) -> DataFrame:
    """key, pattern: how many cases were won and lost, and the statutes cited most (ties by name), as two lines of text."""
    n = cases.groupBy(key).agg(F.count("*").alias("n"), F.count_if(win).alias("w"))
    counts = statutes.filter(F.col(statute).isNotNull()).groupBy(key, statute).agg(F.count("*").alias("c"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("c").desc(), statute))).filter(F.col("_r") <= top)
    names = best.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(statute).cast("string").alias("s")))), lambda x: x["s"]), ", ").alias("names"))
    line = F.format_string("%d cases | %d won / %d lost\nmost cited: %s", "n", "w", F.col("n") - F.col("w"), F.coalesce("names", F.lit("none")))
    return n.join(names, key, "left").select(key, line.alias("pattern"))


def version_counts(versions: DataFrame, law: str, kind: str, kinds: list[str]) -> DataFrame:
    """law, kinds: for each law the number of its versions by kind, as a list in the order of ``kinds``; kinds without any are left out."""
    g = versions.filter(F.col(kind).isin(kinds)).groupBy(law, kind).agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("k"), F.col(kind).alias("kind"), "n"))), lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("version_count")))
    return g.groupBy(law).agg(listed.alias("kinds"))


def newest_unknown(remote: DataFrame, known: DataFrame, kinds: DataFrame, law: str, number: str, order: str) -> DataFrame:
    """law, kind, number, order: the newest remote version of each law, for each of its kinds whose known versions lack its number.

    remote: law, number, order (the newest first counts; ties by the larger number); known: law, kind, number; kinds: law, kind.
    """
    newest = remote.filter(F.col(number).isNotNull() & (F.trim(F.col(number).cast("string")) != "")).groupBy(law).agg(F.max(F.struct(order, number)).alias("m")).select(law, f"m.{number}", f"m.{order}")
    asked = kinds.select(law, "kind").distinct().join(newest, law)
    return asked.join(known.select(law, "kind", number).distinct(), [law, "kind", number], "left_anti").select(law, "kind", number, order)
