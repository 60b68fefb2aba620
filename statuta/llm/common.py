"""Small helpers the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the one the cluster shares (spark.checkpoint.dir).

    Where that setting is missing, a local session (tests on one machine) gets a
    temporary folder for it; on a cluster, whose executors wouldn't see one, it's an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="statuta-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/statuta-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, with a subfolder for each value of the columns ``by``.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` once everything that reads them is written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8), at


def small(batches: Iterator[pa.RecordBatch], *places: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices (views, at least one row each) whose strings at ``places`` take about ``limit`` bytes.

    What Arrow has freed goes back to the system at the end: workers live on between tasks.
    """
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for p in places:
            size += pc.binary_length(batch.column(p)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // limit
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()


def runs(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Bounds [lo, hi) of runs of texts of about ``chars`` characters, at least one text each."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class Covered:
    """The union of spans, asked by bisection whether another span overlaps it."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self._start: list[int] = []
        self._end: list[int] = []
        for s, e in sorted(spans):
            if self._end and s <= self._end[-1]:
                self._end[-1] = max(self._end[-1], e)
            else:
                self._start.append(s)
                self._end.append(e)

    def touches(self, start: int, end: int) -> bool:
        at = bisect_left(self._start, end) - 1
        return at >= 0 and self._end[at] > start


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id's text modulo 4 is 2: rows that no model may learn from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


LONG = (-(1 << 63), (1 << 63) - 1)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of finite doubles, for a scale that is a power of two: as doubles, or as
    Python integers if any is beyond what a double holds exactly."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if np.abs(v).max(initial=0) < 1 << 53:
        return v
    exact = [int(a) * int(scale) if abs(a) >= 1 << 53 else int(np.floor(a * scale)) for a in x.ravel().tolist()]
    return np.array([*exact, None], dtype=object)[:-1].reshape(x.shape)


def exact_kind(*factors: np.ndarray, times: int = 1) -> type:
    """The quickest of float32, float64 and object (Python integers) in which the products of
    rows of two matrices of whole numbers, and ``times`` such a product, are exact."""
    most = times * max(1, *(f.shape[-1] for f in factors))
    for f in factors:
        most *= int(np.abs(f).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def in_kind(v: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers as ``kind``; doubles become Python integers for object."""
    return v.astype(np.int64).astype(object) if kind is object and v.dtype != object else v.astype(kind)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b as longs; a sum beyond a long's range counts as the nearest end of it."""
    out = a @ b
    return (np.clip(out, *LONG) if out.dtype == object else out).astype(np.int64)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; short vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), max(1, int(sizes.max(initial=0))) if dims is None else dims))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widened(v: np.ndarray, dims: int) -> np.ndarray:
    """The rows with zeros behind them, up to ``dims``."""
    out = np.zeros((*v.shape[:-1], dims), dtype=v.dtype)
    out[..., : v.shape[-1]] = v
    return out


def best_rows(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest scores (longs), ties to the smaller id, by row."""
    order = np.lexsort((ident, ~score, row))
    first = np.searchsorted(row[order], row[order])
    return order[np.arange(len(order)) - first < k]
