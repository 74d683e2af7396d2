"""Helpers the operators of this subpackage share: Arrow text buffers, token hashes, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.session import checkpointed

BASE = np.uint64(0x9E3779B97F4A7C15)
LONG = 256
BATCH_BYTES = 4 << 20
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and the offsets of the texts. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return flat, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` bytes; a longer text is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """64-bit hashes of any ranges data[start:end]: differences of one running polynomial sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n + 1, BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])
        power[1:] = INVERSE
        np.cumprod(power, out=power)
        self.back = power

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges. Different long texts exist with equal polynomial sums modulo 2^64 whatever the base (the orders of
    two letters by Thue and Morse, from 1,024 letters on), so ranges of LONG bytes or more are hashed with XXH64."""
    out = Hasher(data)(starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), 1)
    return out


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, start and end of every word). Words are runs of ASCII letters and digits and of anything
    beyond ASCII."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = (lower >= 128) | ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1])[:len(data)] | first[:-1]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True)[:len(data)] | first[1:])) + 1
    return lower, starts, ends


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... start + count - 1 of every pair, one after another."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum()), dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, counts)


def parts(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `limit` bytes, so that what is computed from one stays small."""
    rows = max(1, batch.num_rows // max(1, -(-batch.nbytes // limit)))
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def small_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches by bytes. By default one holds 10,000 rows or 64 MB, and every running task has it in its
    executor's JVM, in buffers outside the heap that grow by doubling, and in its Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system. Python workers live on after a task, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, giving memory back when a task is done."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def with_arrow_columns(df: DataFrame, added: str, fill: Callable[[pa.RecordBatch], list[pa.Array]], close: Callable[[], None] | None = None) -> DataFrame:
    """df with columns computed from whole Arrow batches; a column of the same name is replaced. `close` runs when a task is done.
    Freed memory goes back after every part: a task would otherwise keep the most that any of its parts has used."""
    new = T._parse_datatype_string(added)
    kept = [f for f in df.schema.fields if f.name not in new.fieldNames()]
    schema = T.StructType([*kept, *new.fields])
    names = [f.name for f in kept]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names] + fill(batch)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)],
                                             schema=arrow)
            del columns
            give_back()
        if close:
            close()
        give_back()

    return df.mapInArrow(run, schema)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b), for every node.

    Alternates large-star and small-star over the edge table, which stays the size of the input, until nothing changes; a
    hub's neighbours meet in aggregations only. Every round is written to the checkpoint folder.
    """
    current = checkpointed(edges.where("a is not null and b is not null and a <> b")
                           .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    state = mark(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lows, "a")
        small = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lows.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        current = checkpointed(small)
        now = mark(current)
        # a round leaves the shuffles of four joins and two aggregations; they go at once, not at the end of all rounds
        del both, low, large, lows, joined, small
        drop_unused(nodes.sparkSession)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = current.groupBy("a").agg(F.min("b").alias("component"))
    return (nodes.select("node").join(found, nodes["node"] == found["a"], "left")
            .select("node", F.coalesce("component", "node").alias("component")))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`, which all executors share; local masters without that setting get one of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="waymark-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def drop_unused(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of frames nobody holds any more. Otherwise they stay until the driver's JVM
    happens to collect its garbage, and long chains of steps fill the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to a path below `shared_folder` and read again: its lineage ends there, and lost executors don't matter."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
