"""Known names in texts, by one automaton or by a join on the places that may hold one, and law names resolved to slug and kind."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of one automaton; more are joined with the texts.
NAMES = 100_000
#: Largest filter of a join's names: 2 to this power bits (32 MB).
FILTER = 28
_BUILT: dict[str, object] = {}


def _automaton(key: str, names: list[str]):
    """Built once in a worker for each block of names."""
    import ahocorasick

    if key not in _BUILT:
        if len(_BUILT) >= 8:
            _BUILT.clear()
        a = ahocorasick.Automaton()
        for name in names:
            for said in {name, name.replace(" ", "")} - {""}:
                # two names that are the same without blanks: the longer one, then the first
                old = a.get(said, None)
                if old is None or (-len(name), name) < (-len(old), old):
                    a.add_word(said, name)
        a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def _finder(names):
    """The longest of the broadcast names in each text."""
    key = uuid.uuid4().hex

    @F.pandas_udf("string")
    def find(s: pd.Series) -> pd.Series:
        a = _automaton(key, names.value)
        return s.map(lambda t: min((n for _, n in a.iter(t)), key=lambda n: (-len(n), n), default=None) if isinstance(t, str) and len(a) else None)

    return find


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_SPREAD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: Code points of texts that are searched at once (a longer text by itself).
_PIECE = 1 << 20


class _Windows:
    """Hashes of every window of a row of code points, from sums of what each weighs at its place."""

    def __init__(self, joined: str):
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        powers = lambda by: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(points) - 1, 0), by, np.uint64)]))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * powers(_BASE)[: len(points)])])
        self._back = powers(_BACK)

    def bits(self, at: np.ndarray, length: int, prefix: bool, power: int) -> list[np.ndarray]:
        """The filter's bits for the windows that begin ``at``; whole names and prefixes of names have different ones."""
        h = (self._sums[at + length] - self._sums[at]) * self._back[at]
        h ^= np.uint64((2 * length + prefix) * _SPREAD[2] % (1 << 64))
        h ^= h >> np.uint64(31)
        return [(h * np.uint64(m) >> np.uint64(64 - power)).astype(np.int64) for m in _SPREAD]


def _under(length: int) -> int:
    """How long a prefix stands for names of a length: the power of two that is not greater."""
    return 1 << (length.bit_length() - 1)


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > _PIECE:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _name_bits(power: int):
    def each(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for _, part in _pieces(pdf["said"].tolist()):
                lengths = np.array([len(t) for t in part])
                starts = np.cumsum(lengths) - lengths
                w = _Windows("".join(part))
                found = []
                for n in np.unique(lengths).tolist():
                    at = starts[lengths == n]
                    found += w.bits(at, n, False, power) + w.bits(at, _under(n), True, power)
                yield pd.DataFrame({"p": np.unique(np.concatenate(found))})

    return each


def _candidates(held, lengths: list[int], power: int):
    """(digest of the text, window) for the windows of a text that the filter takes for names."""

    def each(batches: Iterator[pd.DataFrame]):
        filter_ = np.frombuffer(held.value, np.uint8)
        classes: dict[int, list[int]] = {}
        for n in lengths:
            classes.setdefault(_under(n), []).append(n)

        def taken(w, at, n, prefix):
            for p in w.bits(at, n, prefix, power):
                yield (filter_[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

        def hits(w, at, n, prefix):
            return at[np.logical_and.reduce(list(taken(w, at, n, prefix)))]

        for pdf in batches:
            texts = pdf["t"].tolist()
            for first, part in _pieces(texts):
                joined, sizes = "".join(part), np.array([len(t) for t in part])
                row = np.repeat(np.arange(len(part)), sizes)
                left = np.cumsum(sizes)[row] - np.arange(len(row))
                w, out = _Windows(joined), set()
                for under, of in classes.items():
                    begun = hits(w, np.flatnonzero(left >= under), under, True)
                    for n in of:
                        at = hits(w, begun[left[begun] >= n], n, False)
                        out.update((int(r), joined[a : a + n]) for r, a in zip(row[at], at.tolist(), strict=True))
                d = pdf["d"].tolist()
                yield pd.DataFrame([(d[first + r], s) for r, s in sorted(out)], columns=["d", "said"])

    return each


def _joined_names(texts: DataFrame, text: str, known: DataFrame, count: int, out: str) -> DataFrame:
    """longest_name() for any number of names: a filter of bounded size finds the windows that may be names, a join says which are."""
    spark = texts.sparkSession
    said = known.select("n", F.explode(F.array_distinct(F.array("n", F.replace("n", F.lit(" "), F.lit(""))))).alias("said")).filter("said <> ''")
    said = said.groupBy("said").agg(F.min(F.struct((-F.length("n")).alias("l"), "n")).alias("best"))
    lengths = sorted(r[0] for r in said.select(F.length("said")).distinct().collect())
    power = max(15, min(FILTER, (64 * count).bit_length()))
    chunks = said.select("said").mapInPandas(_name_bits(power), "p long").select(F.expr("p DIV 32768").alias("chunk"), (F.col("p") % 32768).alias("p")).repartition("chunk")
    table = bytearray((1 << power) // 8)
    for r in chunks.groupBy("chunk").agg(F.bitmap_construct_agg("p").alias("b")).collect():
        table[r.chunk * 4096 : (r.chunk + 1) * 4096] = r.b
    digest = F.unhex(F.sha2(F.col(text), 256))
    asked = texts.filter(F.col(text).isNotNull()).select(digest.alias("d"), F.col(text).cast("string").alias("t"))
    found = asked.mapInPandas(_candidates(spark.sparkContext.broadcast(bytes(table)), lengths, power), "d binary, said string")
    best = found.join(said, "said").groupBy("d").agg(F.min("best").alias("_best"))
    return texts.withColumn("_d", digest).join(best.withColumnRenamed("d", "_d"), "_d", "left").withColumn(out, F.col("_best.n")).drop("_d", "_best")


def longest_name(texts: DataFrame, text: str, names: DataFrame, name: str, out: str, block: int = NAMES) -> DataFrame:
    """Adds the longest known name that stands in the text, with or without its blanks; of equally long ones the first in UTF-8 order; null without any.

    Up to ``block`` names are broadcast as one automaton, which reads each text once. More are not gathered anywhere: a
    filter of at most 32 MB says which windows of a text may be names, and these are joined with the names, so the work
    follows the texts' length times the number of different lengths of names that begin alike, not the number of names.
    Empty names and null texts match nothing.
    """
    known = names.select(F.col(name).cast("string").alias("n")).filter("n <> ''").distinct()
    count = known.count()
    if count > block:
        return _joined_names(texts, text, known, count, out)
    held = sorted(r.n for r in known.collect())
    return texts.withColumn(out, _finder(texts.sparkSession.sparkContext.broadcast(held))(F.col(text)))


def slug_and_kind(asked: DataFrame, name: str, laws: DataFrame) -> DataFrame:
    """Adds slug and kind of a law name: its own; else, for a decree or rule, its base law's slug with the kind that the ending says; null for others.

    laws: name, slug, kind; a name that stands twice counts as its first slug and kind.
    """
    dim = laws.groupBy("name").agg(F.min(F.struct("slug", "kind")).alias("_d"))
    n = F.col(name)
    ending = F.when(n.endswith("시행규칙"), F.struct(F.lit("rule").alias("kind"), F.trim(F.regexp_replace(n, "시행규칙$", "")).alias("base"))).when(n.endswith("시행령"), F.struct(F.lit("decree").alias("kind"), F.trim(F.regexp_replace(n, "시행령$", "")).alias("base")))
    d = asked.withColumn("_e", ending)
    d = d.join(dim.select(F.col("name").alias("_n"), "_d"), n == F.col("_n"), "left")
    d = d.join(dim.select(F.col("name").alias("_b"), F.col("_d.slug").alias("_s")), F.col("_e.base") == F.col("_b"), "left")
    fallback = F.when(F.col("_s").isNotNull(), F.col("_e.kind"))
    return d.withColumn("slug", F.coalesce("_d.slug", "_s")).withColumn("kind", F.when(F.col("_d").isNotNull(), F.col("_d.kind")).otherwise(fallback)).drop("_e", "_n", "_d", "_b", "_s")
