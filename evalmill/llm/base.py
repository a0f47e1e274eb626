"""What the operators of this package share: session settings, Arrow plumbing, sorted streams."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of an Arrow batch: with texts of some 100 KB a batch still takes a few hundred MB at most.
ARROW_ROWS = 2000
FILTER_WORDS = 1 << 17
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepared(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches unless the session set its own; a checkpoint folder where none is set and the master is local.

    On a cluster a folder of one machine would lose rows, so there the session has to name a shared one.
    """
    if spark.conf.get(_ARROW, "10000") == "10000":
        spark.conf.set(_ARROW, str(ARROW_ROWS))
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; in a session without one, the folder that ``prepared`` has set."""
    prepared(spark)
    return spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder, so that later jobs start from there."""
    prepared(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder while a job goes on; all of them go at its end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[DataFrame] = []

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.tables)}"
        df.write.parquet(path)
        self.tables.append(self.spark.read.schema(df.schema).parquet(path))
        return self.tables[-1]

    def drop(self, df: DataFrame) -> None:
        """Removes a table that the job needs no more."""
        removed(self.spark, f"{self.folder}/{[x is df for x in self.tables].index(True)}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        removed(self.spark, self.folder)


class Seen:
    """Hashes that a worker has met, at most ``limit`` at a time, as one sorted array."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.have = limit, np.empty(0, np.int64)

    def fresh(self, h: np.ndarray) -> np.ndarray:
        """Which of them are met for the first time; the first of equal ones."""
        out = np.zeros(len(h), bool)
        each, first = np.unique(h, return_index=True)
        at = np.searchsorted(self.have, each)
        new = at == len(self.have)
        new[~new] = self.have[at[~new]] != each[~new]
        out[first[new]] = True
        self.have = np.sort(np.concatenate([self.have, each[new]])) if len(self.have) < self.limit else each[new]
        return out


def sieved(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id may be among ``ids`` (one column), and the rows whose id is not, without dealing any row out.

    A Bloom filter of FILTER_WORDS words goes to every worker: 1 MB, however many ids there are.  When it is too full, more
    rows pass than need be.  Rows with a null id are not among the ids.
    """
    word = F.expr(f"pmod(xxhash64(_id), {FILTER_WORDS}L)")
    own = ids.select(F.col(ids.columns[0]).cast("long").alias("_id")).where("_id is not null")
    filled = own.select(word.alias("_word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(_id, 1), 64) as int))").alias("bits"))
    filled = F.broadcast(filled.groupBy("_word").agg(F.bit_or("bits").alias("_bits")))
    names = [f"`{c}`" for c in df.columns]
    rows = df.withColumn("_id", F.col(id_col).cast("long")).withColumn("_word", word).join(filled, "_word", "left")
    maybe = F.coalesce(F.expr("getbit(_bits, cast(pmod(xxhash64(_id, 1), 64) as int)) = 1 and _id is not null"), F.lit(False))
    return rows.where(maybe).select(*names), rows.where(~maybe).select(*names)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and then what the task has freed goes back to the system: workers live on and serve later stages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return work


def annotate(
    df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]], need: list[str] | None = None
) -> DataFrame:
    """``df`` with columns computed batch by batch; a column of ``df`` that has the name of a new one is replaced,
    unless ``make`` reads it (it sees the old one).  ``need``: only these columns of ``df`` go along."""
    prepared(df.sparkSession)
    names = [f.name for f in fields]
    keep = [f for f in df.schema.fields if f.name not in names and (need is None or f.name in need)]
    kept = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + make(batch), kept + names)

    return df.mapInArrow(tidied(run), T.StructType([*keep, *fields]))


def longs(x: np.ndarray | Iterable[int]) -> pa.Array:
    """64-bit values as Spark's long; hashes keep their bits."""
    x = np.asarray(x)
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def packed(df: DataFrame) -> DataFrame:
    """doc_id and text with each text compressed by itself (packed, n_bytes: its length before), for texts that are dealt
    out: what Spark sends then is less than two thirds of what it makes of plain ones."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = pa.Codec("zstd", compression_level=1)
        raw = [None if x is None else x.encode() for x in batch.column("text").to_pylist()]
        data = [None if x is None else codec.compress(x, asbytes=True) for x in raw]
        return [pa.array(data, pa.binary()), pa.array([None if x is None else len(x) for x in raw], pa.int64())]

    fields = [T.StructField("packed", T.BinaryType()), T.StructField("n_bytes", T.LongType())]
    return annotate(df, fields, make, need=["doc_id"])


def unpacked(batch: pa.RecordBatch) -> pa.Array:
    """The texts of rows of ``packed``."""
    codec = pa.Codec("zstd")
    rows = zip(batch.column("packed").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True)
    return pa.array([None if n is None else codec.decompress(x, n, asbytes=True) if n else b"" for x, n in rows], pa.large_binary()).cast(pa.large_string())


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A long column without nulls."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def batch_of(names: list[str], arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a) if a.dtype == bool else longs(a) for a in arrays], names
    )


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Buffer:
    """Gathers arrays of rows until ``limit`` rows are there."""

    def __init__(self, width: int, limit: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(width)]
        self.n, self.limit = 0, limit

    def add(self, *arrays: np.ndarray) -> bool:
        for part, a in zip(self.parts, arrays, strict=True):
            part.append(a)
        self.n += len(arrays[0])
        return self.n >= self.limit

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(p) if p else np.empty(0, np.int64) for p in self.parts]
        self.parts, self.n = [[] for _ in self.parts], 0
        return out


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, under fixed names, so that further columns of any name cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")
