"""Shared pieces: table reading, the shared folder, text batches for Arrow functions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The white space of all word contracts here: exactly what bytes.split() splits on.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Texts handled at once inside an Arrow function, in bytes.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, deleted when the driver ends. Where that is unset, a local master gets a
    temporary folder and any other an error: executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='kura-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/kura/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    store, place = files_of(spark, path)
    store.deleteOnExit(place)
    return path


def files_of(spark: SparkSession, path: str) -> tuple:
    """The file system and path object of a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a table in the shared folder, so that a lost executor costs no recomputation of what is above."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kura_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing will read again."""
    for df in tables:
        store, place = files_of(df.sparkSession, df.kura_path)
        store.delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished plans now; it learns of them when the driver's heap is collected."""
    spark._jvm.System.gc()


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of text each (one text may be longer)."""
    if batch.num_rows == 0:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    cell = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold all rows of each key in them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[n].to_numpy() for n in names]
        cut = int(np.flatnonzero(np.logical_and.reduce([k == k[-1] for k in keys]) ^ True).max(initial=-1)) + 1
        if not cut and rest and all(rest[-1][n][-1].as_py() == k[0] for n, k in zip(names, keys, strict=True)):
            rest.append(batch)  # all of the batch belongs to the key that is still open
            continue
        yield pa.Table.from_batches([*rest, batch.slice(0, cut)], batch.schema)
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts, null as empty."""
    return ["" if t is None else t for t in batch[column].to_pylist()]


def with_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """df without drop, plus the fields that make()(batch) gives for each batch; fields replace columns of the same name.

    make runs once for each task, so that it can load models and hold caches."""
    names = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    schema = T.StructType([*keep, *fields])
    columns = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for batch in chunks(whole, text_col):
                arrays = [batch[c] for c in columns] + fn(batch)
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


LAST: dict = {}


def forget() -> None:
    """Drops what one_at_a_time keeps, and gives freed memory back to the system."""
    LAST.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # else the C library keeps what was freed
        trim(0)


def fresh(run: Callable) -> Callable:
    """run, for tasks that use none of the kept models: the worker drops them first."""

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        return run(batches)

    return begun


def one_at_a_time(fn: Callable) -> Callable:
    """fn with its last result kept, until any other function that is so wrapped is called. Python workers serve one stage after
    another, and each operator's models and memos take up to 200 MB, so a worker holds those of one operator."""

    @wraps(fn)  # by that name it is also found, not copied, where functions are sent to workers
    def get(*args):
        if (fn, args) not in LAST:
            forget()
            LAST[fn, args] = fn(*args)
        return LAST[fn, args]

    return get


class Memo(dict):
    """Results of a function by key, found for many new keys at once. Emptied when it would pass limit keys, so
    that memory is bounded; results don't depend on it."""

    def __init__(self, fn: Callable[[list], Iterable], limit: int = 1 << 19):
        super().__init__()
        self.fn, self.limit = fn, limit

    def learn(self, parts: Iterable[Iterable]) -> Callable:
        """The getter, after all keys in parts are known."""
        keys = set(chain.from_iterable(parts))
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.limit:
            self.clear()
            new = list(keys)
        if new:
            self.update(zip(new, self.fn(new), strict=True))
        return self.__getitem__


def lists_of(parts: list[bytes]) -> pa.ListArray:
    """array<int> column of little-endian int32 strings."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
