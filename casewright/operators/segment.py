"""Sequences inside one document or conversation: blocks, truncation, packing under a budget, state carried down.

Everything is partitioned by the document, so a task holds one document's sequence at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.sources.shared import written


def blocks(df: DataFrame, doc: str, order: list[str], start: Column, end: Column, early: Column) -> DataFrame:
    """Cuts each document into blocks: adds block (0 is the preamble) to every row that has a place.

    A row with ``start`` opens a block and one with ``end`` closes it. Rows before the first start go to the first block
    if ``early`` holds for them, and to the preamble otherwise; rows between a close and the next start go to the preamble.
    """
    upto = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_s", start).withColumn("_e", end)
    d = d.withColumn("_n", F.sum(F.col("_s").cast("int")).over(upto))
    own = Window.partitionBy(doc, "_n").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_closed", F.coalesce(F.max(F.col("_e").cast("int")).over(own), F.lit(0)))
    some = F.max("_n").over(Window.partitionBy(doc))
    block = F.when((F.col("_n") == 0) & early & (some > 0), 1).when((F.col("_n") == 0) | (F.col("_closed") == 1), 0).otherwise(F.col("_n"))
    return d.withColumn("block", block.cast("int")).drop("_s", "_e", "_n", "_closed")


def running_blocks(df: DataFrame, doc: str, order: list[str], start: Column) -> DataFrame:
    """Blocks that open at every start; rows before the first are block 0."""
    upto = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("block", F.sum(start.cast("int")).over(upto).cast("int"))


def truncate_after_last(df: DataFrame, doc: str, order: str, mark: Column) -> DataFrame:
    """Rows up to each document's last marked row; all rows where none is marked."""
    last = F.max(F.when(mark, F.col(order))).over(Window.partitionBy(doc))
    return df.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).drop("_last")


def packed(items: Column, size, budget: int) -> Column:
    """Where chunks begin in an array of items (from 0): an item that would exceed the budget opens a chunk.

    An item larger than the budget opens a chunk that nothing is added to; no chunk is empty.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        n = size(x).cast("long")
        opens = (a["at"] == 0) | (a["used"] + n > budget)
        return F.struct((a["at"] + 1).alias("at"), F.when(opens, n).otherwise(a["used"] + n).alias("used"), F.when(opens, F.concat(a["out"], F.array(a["at"]))).otherwise(a["out"]).alias("out"))

    return F.aggregate(items, start, step, lambda a: a["out"])


def pack_rows(df: DataFrame, doc: str, order: str, text: str, size, budget: int, join: str = "\n") -> DataFrame:
    """doc, chunk, n_items, text: each document's texts packed in order into chunks under the budget."""
    lists = df.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("_items"))
    begins = lists.withColumn("_b", packed(F.col("_items"), size, budget))
    ends = F.concat(F.slice("_b", 2, F.size("_b")), F.array(F.size("_items")))
    cut = begins.select(doc, "_items", F.posexplode(F.arrays_zip(F.col("_b").alias("b"), ends.alias("e"))).alias("chunk", "z"))
    n = F.col("z.e") - F.col("z.b")
    return cut.select(doc, "chunk", n.cast("long").alias("n_items"), F.array_join(F.slice("_items", F.col("z.b") + 1, n), join).alias(text))


def char_chunks(df: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """keys, part (from 1), text: texts cut into pieces of ``size`` characters; an empty text has none."""
    n = F.ceil(F.length(text) / size).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("part"), F.substr(F.col(text), (i - 1) * size + 1, F.lit(size)).alias(text))))
    return df.select(*keys, F.inline(parts))


def count_chunks(df: DataFrame, doc: str, order: str, size: int) -> DataFrame:
    """Adds chunk: ``size`` rows to each, in order."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    return df.withColumn("chunk", F.floor(rank / size).cast("int"))


def carry(df: DataFrame, doc: str, order: list[str], levels: dict[str, Column]) -> DataFrame:
    """Adds for each level the value last seen above or at the row; a new value of a level clears the levels below it."""
    d, within = df, [doc]
    for name, value in levels.items():
        d = d.withColumn(f"_v_{name}", value)
        upto = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn(name, F.last(f"_v_{name}", ignorenulls=True).over(upto)).withColumn(f"_k_{name}", F.count(f"_v_{name}").over(upto))
        within = [*within, f"_k_{name}"]
    return d.drop(*[c for c in d.columns if c.startswith(("_v_", "_k_"))])


def reindex(df: DataFrame, group: list[str], order: list[str], prefix: str, name: str) -> DataFrame:
    """Adds PREFIX1, PREFIX2, ... in order within each group."""
    return df.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*group).orderBy(*order))))


def last_turns(df: DataFrame, conversation: str, turn: str, role: str, text: str, turns: int = 6, chars: int = 600) -> DataFrame:
    """conversation, history: the last user and assistant turns, oldest first, each cut to ``chars`` characters."""
    d = df.filter(F.col(role).isin("user", "assistant"))
    rank = F.row_number().over(Window.partitionBy(conversation).orderBy(F.col(turn).desc()))
    d = d.withColumn("_r", rank).filter(F.col("_r") <= turns).withColumn("_t", F.concat(role, F.lit(": "), F.substring(text, 1, chars)))
    return d.groupBy(conversation).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(turn, "_t"))), lambda x: x["_t"]), "\n").alias("history"))


def context_query(query: Column, last_answer: Column, chars: int = 300) -> Column:
    """The query with the beginning of the last answer before it, if there is one."""
    return F.when(F.coalesce(last_answer, F.lit("")) == "", query).otherwise(F.concat(F.substring(last_answer, 1, chars), F.lit("\n"), query))


def reduce_in_one_job(df: DataFrame, doc: str, order: str, text: str, size, budget: int, shorten, join: str = "\n", block: int = 10_000) -> DataFrame:
    """doc, text: each document's texts packed and shortened level by level until one is left, in one job.

    ``shorten`` and ``size`` are Column -> Column. A document's levels run within its row as one expression, as many as it
    needs. Documents of over ``block`` texts are first packed and shortened by runs of ``block``, so no row holds more than
    a run's texts, then their packs; a pack never spans two runs. The job fails where two texts that are left do not fit
    the budget.
    """
    d = df.select(doc, F.col(order).alias("_o"), F.coalesce(text, F.lit("")).alias(text))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("_o", text)) - 1

    def level(items: Column) -> Column:
        """Packs of the texts, each shortened."""
        pack = lambda z: shorten(F.array_join(F.slice(items, z["b"] + 1, z["e"] - z["b"]), join))
        ends = lambda begins: F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(items)))
        return x.once(packed(items, size, budget), lambda begins: F.transform(F.arrays_zip(begins.alias("b"), ends(begins).alias("e")), pack))

    def reduced(items: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(items)), items, lambda acc, _: F.when(F.size(acc) > 1, level(acc)).otherwise(acc))

    texts = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("_o", F.col(c)))), lambda t: t[c])
    runs = d.withColumn("_run", F.floor(rank / block)).groupBy(doc, "_run").agg(texts(text).alias("_t"))
    # a document of one run is not shortened before its own levels
    runs = runs.select(doc, F.col("_run").alias("_o"), F.when(F.size("_t") > 1, reduced(F.col("_t"))).otherwise(F.col("_t")).alias("_t"))
    whole = runs.groupBy(doc).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_t"))), lambda t: t["_t"])).alias("_t")).withColumn("_t", reduced(F.col("_t")))
    left = F.raise_error(F.concat(F.lit("texts left that do not fit the budget: "), F.col(doc).cast("string")))
    return whole.select(doc, F.when(F.size("_t") == 1, F.col("_t")[0]).otherwise(left.cast("string")).alias(text))


def reduce_until_one(df: DataFrame, doc: str, order: str, text: str, size, budget: int, shorten, rounds: int = 20) -> DataFrame:
    """Packs and shortens each document's texts again and again until one is left; ``shorten`` is a Column -> Column.

    Each round at least halves what is packed if two items fit a budget, so rounds are few. Each round is written
    (shared.written), so none is computed twice. Raises if some document has more than one text after ``rounds``.
    """
    d = df.select(doc, F.col(order).alias("_o"), text)
    for _ in range(rounds):
        d = written(pack_rows(d, doc, "_o", text, size, budget).select(doc, F.col("chunk").alias("_o"), shorten(F.col(text)).alias(text)), "reduce")
        if d.filter("_o > 0").isEmpty():
            return d.drop("_o")
    raise ValueError(f"texts left after {rounds} rounds: two of them do not fit the budget")
