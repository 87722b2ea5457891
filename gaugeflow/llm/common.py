"""Shared helpers: scratch tables in the shared folder, Arrow text views, row ids."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python; texts can be long, so batches stay small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size (never raises it), so a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """While it holds, plans that run hand Python at most so many rows at a time: for rows that hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(columns: list[str], name: str) -> str:
    """A column name that a table doesn't have yet."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="gaugeflow-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs one stage, not the whole plan."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n, self.written = 0, []
        atexit.register(self.clear)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str = "t", compression: str = "zstd") -> DataFrame:
        path = self.path(name)
        self.written.append(path)
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames) -> None:
        """Removes tables that no later plan reads."""
        for f in frames:
            path = f if isinstance(f, str) else getattr(f, "_scratch_path", None)
            if path:
                self._delete(path)

    def only(self, *frames) -> None:
        """Removes every table but these: once what was asked for is written, nothing that led to it is read again."""
        keep = {f._scratch_path for f in frames}
        for path in [p for p in self.written if p not in keep]:
            self._delete(path)
        self.written = [p for p in self.written if p in keep]

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended: nothing is left to ask
            pass


#: What workers keep between tasks, by name, and how to let go of it.
_KEPT: dict[str, Callable[[], None]] = {}


def kept_by(name: str, clear: Callable[[], None]) -> None:
    _KEPT[name] = clear


def settle(own: str = "") -> None:
    """Called by a worker as it starts a task: lets go of what tasks of other operators have kept, and returns freed
    memory to the system. Workers serve many tasks, and what they hold adds up beside the executor's heap."""
    for name, clear in _KEPT.items():
        if name != own:
            clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets that bound each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    base = int(offsets[0]) if len(offsets) else 0
    end = int(offsets[-1]) if len(offsets) else 0
    raw = np.frombuffer(data, dtype=np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    return raw, offsets - base


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    raw, offs = utf8(column)
    buf = raw.tobytes()
    ends = offs.tolist()
    return [buf[a:b] for a, b in zip(ends, ends[1:])]


def pieces(raw: np.ndarray, offs: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most max_bytes each; a longer single row stands alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
