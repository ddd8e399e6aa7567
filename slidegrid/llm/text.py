"""Vectorised text helpers shared by the corpus operators.

All of them work on a small list of byte strings at a time (``chunks`` bounds
its size), so memory follows the longest single text and never the partition.
"""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="slidegrid-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: While a table is written: shuffle files go once it is complete, and batches for Python stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def _store(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The table stays for those who read the result, as files of ``checkpoint`` do.
    """
    return _store(df, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


class Scratch:
    """The tables of one run of an operator, in a folder that goes when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, label: str) -> DataFrame:
        return _store(df, f"{self.path}/{label}-{uuid.uuid4().hex}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def trim() -> None:
    """Give freed memory back to the system, with the tables of powers, as Python workers outlive their tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function of Arrow batches, that ends with ``trim``."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trimmed(run: Callable) -> Callable:
    """``run``, a function of Arrow arrays, with ``trim`` after each batch."""

    @functools.wraps(run)
    def wrapped(*columns: pa.Array) -> pa.Array:
        try:
            return run(*columns)
        finally:
            trim()

    return wrapped


def column(name: str) -> Column:
    """A column by its plain name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Ids are looked up by so many slots of their hash at most.
SLOTS = 1 << 20


def split_by_ids(rows: DataFrame, name: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``name`` may be one of ``ids.doc_id``, and the others, which so need no shuffle.

    Ids meet by slot, so what is broadcast is bounded; false hits stay on the
    first side.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(ids.select(slot("doc_id").alias("_slot")).distinct())
    rows = rows.withColumn("_slot", slot(name))
    return rows.join(slots, "_slot", "left_semi").drop("_slot"), rows.join(slots, "_slot", "left_anti").drop("_slot")


def with_text(docs: DataFrame, new: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct ``_row``, with another text; ``n_chars`` follows it where it exists."""
    kinds = {f.name: f.dataType for f in docs.schema}
    put = {"text": new, "n_chars": F.length(new)}
    return [put[c].cast(kinds[c]).alias(c) if c in put else F.col("_row").getField(c).alias(c) for c in docs.columns]


def byte_column(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts hold about ``limit`` bytes; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of powers spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        tables = []
        for base in (_MUL, _INV):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        if size > 1 << 22:  # a rare long text must not stay in memory
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash each word ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns the 64-bit hashes of all words in order, the index of each text's
    first word (one entry more than texts), and each word's start and end byte
    within its own text.
    """
    blob = b" ".join(texts) + b" "
    raw = np.frombuffer(blob, dtype=np.uint8)
    a = _LOWER[raw] if lower else raw
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    pw, inv = _power_tables(len(a) + 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * pw[: len(a)], out=total[1:])
    h = mix((total[end] - total[start]) * inv[start])
    bound = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bound[1:])
    first = np.searchsorted(start, bound)
    base = np.repeat(bound[:-1], np.diff(first))
    return h, first, start - base, end - base


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; position i covers words i to i + n - 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : k + m]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, A-Z lower-cased.

    A text of fewer words has its whole word sequence as its only shingle; a
    text without words has an empty set.
    """
    h, first, _, _ = word_hashes(texts)
    w = window_hashes(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(w[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(h[:0])
    return out
