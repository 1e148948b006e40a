"""Helpers shared by the corpus operators: tables, the shared folder, and Arrow text access."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from regionflow.session import reachable

#: Bytes of text that a vectorised kernel holds at once; a longer document is held alone.
CHUNK_BYTES = 1 << 20

#: White space that separates words: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; set here only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise once and cut the lineage; the files lie in the shared folder, so a lost executor loses nothing.

    What the result's plan knows of its partitioning stays, which saves exchanges.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """cut(), and forget the plan's constraints and size estimates as well: they multiply with every turn of a loop.

    No more partitions than cores: what loops pass on is small beside the texts, and each partition costs files in
    every exchange to come.
    """
    spark = df.sparkSession
    held = cut(df.coalesce(max(1, spark.sparkContext.defaultParallelism)))._jdf
    made = spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False)
    return DataFrame(made, spark)


def sweep(spark: SparkSession) -> None:
    """Have the files of shuffles dropped whose results are materialised: Spark does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that this library wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that Spark hands to Python at once; a few hundred long documents fit beside the heap.
BATCH_ROWS = 400


#: Settings of the C allocator in Python workers: large arrays go back to the system as soon as they are freed, so
#: that a worker between tasks holds little memory.
ALLOCATOR = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows, as texts can be long, and what workers keep. The session keeps smaller settings of its own."""
    for name, value in ALLOCATOR.items():
        spark.sparkContext.environment.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    reachable(spark)
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one call per bounded slice of each batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes in the string columns, or of one row."""
    sizes = np.zeros(batch.num_rows + 1, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes[1:] += np.diff(offsets(column))
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1] or bytes(8), kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and each row's offsets in them."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def byte_rows(column: pa.Array) -> list[bytes]:
    data, at = utf8(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the range of its words."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    space = _SPACE[data]
    first, last = np.empty_like(space), np.empty_like(space)
    first[0] = last[-1] = True
    first[1:], last[:-1] = space[:-1], space[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = True
    last[edges - 1] = True
    starts = np.flatnonzero(~space & first)
    ends = np.flatnonzero(~space & last) + 1
    return starts, ends, np.searchsorted(starts, at)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash, and of its inverse mod 2^64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the bytes stand."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # blocks of spans, so that long rows need no long tables
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK_BYTES)))
        low, high = int(starts[at]), int(ends[at:stop].max())
        up, down = powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = stop
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
