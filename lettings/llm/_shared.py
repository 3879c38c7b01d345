"""What the training-data operators share: tables, written cut points, word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch: documents may be long, so batches stay small.
BATCH_ROWS = 256
#: Largest table, in rows of a few numbers, that is broadcast after it was counted.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a new one on this machine, if all runs here; else an error."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lettings-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Written tables of the steps that are under way in this thread, innermost last.
UNDER_WAY: ContextVar[tuple[list[Cut], ...]] = ContextVar("UNDER_WAY", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside are deleted at the end, but for those to keep.

    Then the driver's garbage is collected, since Spark deletes the shuffle files of what has ended only after that.
    """
    token = UNDER_WAY.set((*UNDER_WAY.get(), []))
    try:
        yield
    finally:
        cuts = UNDER_WAY.get()[-1]
        UNDER_WAY.reset(token)
        for cut in cuts:
            cut.drop()
        if cuts:
            gc.collect()
            cuts[0].spark.sparkContext._jvm.System.gc()


class Cut:
    """A table written to the shared folder: lineage ends there, and lost executors don't matter.

    Within ``scratch()`` it is deleted at the end; with ``keep`` at the end of what is around that, if anything.
    """

    def __init__(self, df: DataFrame, name: str = "cut", path: str | None = None, keep: bool = False, **options: object):
        spark = df.sparkSession
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/lettings/{name}-{uuid.uuid4().hex}"
        writer = df.write
        for key, value in options.items():
            writer = writer.option(key.replace("__", "."), value)
        writer.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        if (steps := UNDER_WAY.get())[: len(UNDER_WAY.get()) - keep]:
            steps[-1 - keep].append(self)

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has no more rows than the limit; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


IS_SPACE, LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint64) + 1
IS_SPACE[[32, *range(9, 14)]] = True
LOWER[65:91] += 32
#: Base of the polynomial that hashes a word's bytes modulo 2^64, odd so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if not POWERS or len(POWERS[0]) < n:
        n = 1 << max(16, n.bit_length())
        POWERS[:] = [np.cumprod(np.full(n, b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return POWERS


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased, and the number of words of each; null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = IS_SPACE[data]
    before, after = np.append(True, space[:-1]), np.append(space[1:], True)
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after)
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # words of about an eighth of a megabyte at a time; a longer word is one round
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 17), side="right")))
        first, last = starts[i:j] - starts[i], ends[i:j] - starts[i]
        n = int(last[-1]) + 1
        up, down = powers(n)
        sums = np.cumsum(LOWER[data[starts[i] : starts[i] + n]] * up[:n])
        sums = sums[last] - np.where(first > 0, sums[first - 1], np.uint64(0))
        hashes[i:j] = mixed(sums * down[first] + (last - first).astype(np.uint64))
        i = j
    return hashes, np.diff(np.searchsorted(starts, offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded rows, so that what a function makes of one is bounded.

    The session's limit of rows in an Arrow batch is lowered to ``BATCH_ROWS`` if it is higher, and stays so:
    Spark reads it when the result is computed, and larger batches of texts would be held by executor and worker at once.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(i, BATCH_ROWS)

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(few(batches))
        # Workers outlive their tasks: what they have freed goes back to the system, so that idle ones stay small.
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(freed, schema)
