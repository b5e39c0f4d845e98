"""Answers of a model kept by the content they were asked about: equal units are asked once, and a run that breaks off goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.sources.shared import written
from casewright.sources.versioned import VersionedTable

#: digest of model and content; claimed, done or failed; the claiming run; calls so far; answer or last error.
SCHEMA = "digest string, status string, owner string, calls int, answer string"


def memo_table(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    return VersionedTable.create(spark, path, SCHEMA, ["digest"], buckets)


def _digest(model: str, text: str):
    return F.sha2(F.concat(F.lit(model), F.lit("\u001f"), F.coalesce(F.col(text), F.lit(""))), 256)


def memoised(units: DataFrame, text: str, model: str, ask: Callable[[str], str], memo: VersionedTable, owner: str, pages: int = 4, tries: int = 3, takeover: bool = False) -> DataFrame:
    """Units with ``answer`` (null where the model failed ``tries`` times, in this run and earlier ones together).

    Contents are addressed by the digest of model name and text. Each content that has no answer is claimed by this run
    (``owner``) in the memo, which fails over to the other where two runs claim at once, then asked in ``pages`` lots; each
    lot's answers and failures are committed before the next lot starts, so what an interrupted run paid for stays. Claims
    of other runs are left alone unless ``takeover``. A failed call is noted and asked again by a later run. Only digests
    are compared with the memo; a run shuffles the units' texts once and writes those it asks about. ``units`` is read for
    the digests, for the texts and for the result, so stage it if it is costly.
    """
    asked = units.withColumn("_digest", _digest(model, text))
    known = memo.read().withColumnRenamed("digest", "_k")
    open_ = asked.select(F.col("_digest").alias("digest")).distinct().join(known, F.col("digest") == F.col("_k"), "left").filter(
        F.col("_k").isNull() | ((F.col("status") == "failed") & (F.col("calls") < tries)) | ((F.col("status") == "claimed") & (F.lit(takeover) | (F.col("owner") == owner))))
    todo = written(open_.select("digest", F.col("_k").isNotNull().alias("known"), F.coalesce("calls", F.lit(0)).alias("calls"), F.pmod(F.xxhash64("digest"), F.lit(pages)).alias("page")), "memo-todo")
    claim = todo.select("digest", "known", F.lit("claimed").alias("status"), F.lit(owner).alias("owner"), "calls", F.lit(None).cast("string").alias("answer"))
    for again in (False, True):
        part = claim.filter(F.col("known") == again).drop("known")
        if not part.isEmpty():
            # a new content is claimed only where no other run has been first
            memo.merge(part, keep=() if again else ("status", "owner", "calls", "answer"))

    def each(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for d, t, calls in zip(pdf["digest"], pdf["text"], pdf["calls"], strict=True):
                try:
                    out.append((d, "done", owner, calls + 1, ask(t)))
                except Exception as e:
                    out.append((d, "failed", owner, calls + 1, str(e)[:500]))
            yield pd.DataFrame(out, columns=["digest", "status", "owner", "calls", "answer"])

    mine = memo.read().filter((F.col("status") == "claimed") & (F.col("owner") == owner)).select("digest")
    claimed = todo.join(mine, "digest", "left_semi").select("digest", "calls", "page")
    # copies are reduced where they lie, so a frequent content does not gather in one task
    contents = asked.groupBy(F.col("_digest").alias("digest")).agg(F.first(text).alias("text"))
    texts = written(contents.join(claimed, "digest"), "memo-texts")
    for page in range(pages):
        lot = written(texts.filter(F.col("page") == page).select("digest", "text", "calls").mapInPandas(each, SCHEMA), "memo-answers")
        if not lot.isEmpty():
            memo.merge(lot)
    answers = memo.read().filter("status = 'done'").select(F.col("digest").alias("_digest"), "answer")
    return asked.join(answers, "_digest", "left").drop("_digest")
