"""What several operators share: tables kept between steps, and words and hashes of whole Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_OWN: list[str] = []
_NOTED: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="casewright-"))
    return _OWN[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    note(path)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def note(path: str) -> None:
    """Names a folder that scratch() deletes."""
    for paths in _NOTED[-1:]:
        paths.append(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, what was staged within it. Results that were read from there must be written by then."""
    _NOTED.append([])
    try:
        yield
    finally:
        for path in _NOTED.pop():
            _delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, t.staged_path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def of_files(df: DataFrame) -> bool:
    """Whether df is a table of files and nothing else, so that its rows have a file and a row number."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def keyed(df: DataFrame, name: str) -> DataFrame:
    """doc (all columns of df), and __file and __row, which name each row and are the same in every plan; staged unless df is a table of files."""
    if not of_files(df):
        df = stage(df, name)
    doc = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("doc")
    # the files' own metadata, also where a column has its name
    place = df.metadataColumn("_metadata")
    return df.select(doc, place["file_path"].alias("__file"), place["row_index"].alias("__row"))


def n_words(text) -> F.Column:
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# Hashes: a random 64-bit number for each byte, a polynomial over them modulo 2**64, and a finishing mix.
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _P) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            both.append(p)
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, most: int = 1 << 21):
    """Yields (first row, bytes, offsets) for runs of rows of about ``most`` bytes; one long text is never cut. Null is empty."""
    column = pa.compute.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of A-Z-lower-cased texts, and the first word of each text (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inner = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inner[:-1]))
    starts = np.flatnonzero(inner & (~before | cut[:n]))
    after = np.concatenate((inner[1:], [False]))
    ends = np.flatnonzero(inner & (~after | cut[1:]))
    up, down = powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER_BYTE[data] * up[:n], dtype=np.uint64)))
    return mix((total[ends + 1] - total[starts]) * down[starts]), np.searchsorted(starts, offsets)
