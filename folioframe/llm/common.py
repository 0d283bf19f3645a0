"""Shared plumbing of the corpus operators: shared scratch tables and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that one slice of an Arrow batch may hold before it is cut again (one row is never cut).
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on one machine a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MEMOS: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Say at a task's start whose memo this Python worker is to hold: those of other operators are dropped, and their memory is given back."""
    others = [n for n in _MEMOS if n != name]
    for other in others:
        _MEMOS.pop(other)()
    _MEMOS[name] = clear
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory to the machine: workers outlive their tasks, and their allocators keep what they once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs herein go when it ends, not when the driver happens to collect its garbage; what it wrote stays."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def integer_components(vector, scale: int):
    """floor(scale * x) of each component x as a double that holds a whole number; null where the vector or a component is null or a component not finite.

    From 2^52 on a double is whole itself; beyond 1e300 it counts as 1e300, as scaled ones must stay finite.
    """
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x) < float(1 << 52) / scale, F.floor(F.lit(float(scale)) * x).cast("double")).otherwise(F.rint(F.lit(float(scale)) * F.greatest(F.least(x, F.lit(1e300)), F.lit(-1e300))))
    return F.when(vector.isNotNull() & fits, F.transform(vector, lambda x: whole(x.cast("double"))))


def integers(whole: np.ndarray) -> np.ndarray:
    """Doubles that hold whole numbers as int64, or as Python's integers where one is too large."""
    if not whole.size or np.abs(whole).max() < float(1 << 62):
        return whole.astype(np.int64)
    return np.array([[int(x) for x in row] for row in whole], object).reshape(whole.shape)


def product_bound(a: np.ndarray, b: np.ndarray) -> int:
    """A size that no inner product of these integer rows passes."""
    if not a.size or not b.size:
        return 0
    return max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min()))) * a.shape[1]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; those beyond 63 bits become the largest or smallest such number."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = product_bound(a, b)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    ends = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, ends.min, ends.max).astype(np.int64)


def utf8_size(text: str):
    """Bytes of the text in UTF-8; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice's texts stay under `limit` bytes, unless one row alone is larger."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(total):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns computed from whole texts, slice by slice, without a shuffle.

    `make()` runs once per task and returns the function from a slice to the new arrays. Columns of
    `df` that clash with a new name are replaced.
    """
    names = [f.name for f in fields]
    kept = [c for c in (keep if keep is not None else df.columns) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    src = df.select(*dict.fromkeys([*kept, text])) if text not in kept else df.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, text):
                new = fn(part)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, names=kept + names)

    return src.mapInArrow(run, schema)


def texts_of(part: pa.RecordBatch, column: str) -> list[str]:
    """The slice's texts; null becomes empty."""
    return [t or "" for t in part.column(column).to_pylist()]


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small enough for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
