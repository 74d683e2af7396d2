"""Embedding near-duplicates: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import components
from waymark.session import checkpointed

BATCH = 2048


@dataclass(frozen=True)
class Index:
    """tables x (1 home and `probes` - 1 further buckets) per vector; `hashes` cross-polytope hashes make a bucket's code.

    A bucket with more than `block` rows is compared block by block, so no task holds a whole bucket.
    """

    tables: int = 8
    hashes: int = 2
    probes: int = 3
    rotations: int = 3
    block: int = 1024
    seed: int = 42


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, index: Index) -> np.ndarray:
    """(row, table, probe): bucket codes of unit vectors, the home bucket first, then those that replace one hash by its
    runner-up, the closest call first."""
    n, d = x.shape
    size = 1 << max(0, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    out = np.empty((n, index.tables, index.probes), np.int64)
    for t in range(index.tables):
        first, second, gap = [], [], []
        for k in range(index.hashes):
            rng = np.random.default_rng([index.seed, t, k, size])
            y = padded
            for _ in range(index.rotations):
                y = hadamard(y * rng.choice((-1.0, 1.0), size))
            strength = np.abs(y)
            best = strength.argmax(1)
            rows = np.arange(n)
            top = strength[rows, best].copy()
            strength[rows, best] = -1
            other = strength.argmax(1)
            first.append(best * 2 + (y[rows, best] > 0))
            second.append(other * 2 + (y[rows, other] > 0))
            gap.append(top - strength[rows, other])
        place = (2 * size) ** np.arange(index.hashes)
        home = sum(f * p for f, p in zip(first, place, strict=True))
        out[:, t, 0] = home
        change = np.stack([(s - f) * p for f, s, p in zip(first, second, place, strict=True)], 1)
        order = np.argsort(np.stack(gap, 1), 1, kind="stable")
        for q in range(1, index.probes):
            out[:, t, q] = home + np.take_along_axis(change, order[:, q - 1:q], 1)[:, 0]
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vec): vectors without null or non-finite components and not all zero, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.abs(x)))
    return vectors.select(F.col(key), v.alias("vec")).where(F.col(key).isNotNull() & (fine > 0))


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length among the vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaling first keeps very small and very large vectors exact enough."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucket_rows(classes: DataFrame, index: Index, full: bool) -> DataFrame:
    """(bucket, class_id, home): every bucket a vector is filed in or looks into; `full` adds its n, vector and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column("class_id").to_numpy(), batch.column("n").to_numpy()
            for rows, x in _matrix(batch.column("vec")):
                for low in range(0, len(rows), BATCH):
                    some, part = rows[low:low + BATCH], unit(x[low:low + BATCH])
                    c = codes(part, index)
                    table = np.arange(index.tables, dtype=np.int64)[None, :, None]
                    bucket = (table << 57 | np.int64(part.shape[1]) << 40 | (c & ((1 << 40) - 1))).reshape(len(some), -1)
                    each = bucket.shape[1]
                    home = np.tile(np.arange(each) % index.probes == 0, len(some))
                    columns = {"bucket": bucket.ravel(), "class_id": np.repeat(ids[some], each), "home": home}
                    if full:
                        raw = np.repeat(part.astype("<f8").view(f"S{8 * part.shape[1]}").ravel(), each)
                        columns |= {"n": np.repeat(n[some], each)}
                        vec = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(
                            (np.arange(len(raw) + 1) * 8 * part.shape[1]).astype(np.int32)), pa.py_buffer(raw.tobytes())])
                        code = np.repeat(bucket.astype("<i8"), each, 0)
                        columns |= {"vec": vec, "codes": pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(
                            (np.arange(len(raw) + 1) * 8 * each).astype(np.int32)), pa.py_buffer(code.tobytes())])}
                    yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    schema = "bucket bigint, class_id bigint, home boolean" + (", n bigint, vec binary, codes binary" if full else "")
    return classes.mapInArrow(run, schema)


def _compare(group: dict[str, np.ndarray], index: Index, least: float) -> tuple[np.ndarray, ...]:
    """Of one block pair: (class, links counted here, a class linked to it) for the classes with a link.

    A pair meets in several buckets and is counted in the first one only: the lowest table, and there the home bucket of the
    smaller id if the other side looks into it. Of the links, a chain that connects the same classes is kept.
    """
    x = np.frombuffer(b"".join(group["vec"]), "<f8").reshape(len(group["class_id"]), -1)
    code = np.frombuffer(b"".join(group["codes"]), "<i8").reshape(len(x), index.tables, index.probes)
    ids, home, side = group["class_id"], group["home"], group["side"]
    close = x @ x.T >= least
    close &= home[:, None] | home[None, :]
    if side.any():  # blocks i < j: only pairs across
        close &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(close, 1))
    if not len(a):
        return (np.empty(0, np.int64),) * 3
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    counted = np.empty(len(a), bool)
    for low in range(0, len(a), 1 << 16):
        p, q = a[low:low + (1 << 16)], b[low:low + (1 << 16)]
        finds = (code[q] == code[p][:, :, :1]).any(2)
        found = (code[p] == code[q][:, :, :1]).any(2)
        meets = finds | found
        t = meets.argmax(1)
        rows = np.arange(len(p))
        at = np.where(finds[rows, t], code[p, t, 0], code[q, t, 0])
        counted[low:low + (1 << 16)] = at == group["bucket"]
    n = group["n"]
    links = np.bincount(a[counted], n[b[counted]], len(x)) + np.bincount(b[counted], n[a[counted]], len(x))
    label = np.arange(len(x))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    touched = np.zeros(len(x), bool)
    touched[a] = touched[b] = True
    return ids[touched], np.rint(links[touched]).astype(np.int64), ids[label[touched]]


def partial_links(classes: DataFrame, index: Index, least: float) -> DataFrame:
    """(class_id, links, near): links counted per block, and a class linked (perhaps through others of the block)."""
    sizes = bucket_rows(classes, index, False).groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > index.block)
    crowded = checkpointed(sizes.select("bucket", F.ceil(F.col("rows") / index.block).cast("int").alias("blocks")))
    rows = bucket_rows(classes, index, True)
    known = F.broadcast(crowded) if crowded.count() <= 200_000 else crowded
    rows = rows.join(known, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).alias("side"),
                       "class_id", "home", "n", "vec", "codes").drop("own", "with")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> tuple[np.ndarray, ...]:
            g = {c: table.column(c).to_numpy() for c in ("class_id", "home", "n", "side")}
            g |= {c: table.column(c).to_pylist() for c in ("vec", "codes")}
            g["bucket"] = table.column("bucket")[0].as_py()
            return _compare(g, index, least)

        def groups(table: pa.Table, last: bool) -> Iterator[tuple[np.ndarray, ...]]:
            keys = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
            new = np.zeros(len(table), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(table)]
            for low, high in zip(cuts[:-1], cuts[1:] if last else cuts[1:-1], strict=False):
                if high - low > 1:
                    yield flush(table.slice(low, high - low))
            held[:] = [] if last else table.slice(cuts[-2]).to_batches()

        def out(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, n, b = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.RecordBatch.from_pydict({"class_id": pa.array(a), "links": pa.array(n), "near": pa.array(b)})

        schema = None
        for batch in batches:
            schema = batch.schema
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4096:
                if found := [f for f in groups(pa.Table.from_batches(held), False) if len(f[0])]:
                    yield out(found)
        if held and schema is not None:
            if found := [f for f in groups(pa.Table.from_batches(held), True) if len(f[0])]:
                yield out(found)

    return dealt.mapInArrow(run, "class_id bigint, links bigint, near bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95,
                    index: Index | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: other vectors linked directly, and the smallest key reachable.

    Two vectors link if their cosine, in double precision, is at least `least` and one looks into the other's home bucket in
    any table; every pair found is verified. Equal vectors are one class, compared once, and count as links of each other.
    Vectors of different lengths do not link; null vectors, those with null or non-finite components and zero vectors link
    with nothing; a null key has no component. Repeated rows count as vectors of their own; an empty table gives no rows; other
    columns are not read.
    """
    index = index or Index()
    good = usable(vectors, key, vector).withColumnRenamed(key, "_id")
    classes = checkpointed(good.groupBy("vec").agg(F.min("_id").alias("class_id"), F.count("*").alias("n")).select("class_id", "n", "vec"))
    members = good.join(classes, "vec").select("_id", "class_id", "n")
    found = checkpointed(partial_links(classes, index, least).groupBy("class_id", "near").agg(F.sum("links").alias("links")))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    ids = components(classes.select(F.col("class_id").alias("node")), found.select(F.col("class_id").alias("a"), F.col("near").alias("b")))
    of_class = ids.withColumnRenamed("node", "class_id").join(links, "class_id", "left")
    done = (members.join(of_class, "class_id").groupBy("_id")
            .agg(F.min("component").alias("component_id"), F.max(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    return (vectors.select(F.col(key)).join(done, F.col(key) == F.col("_id"), "left")
            .select(key, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", key).alias("component_id"),
                    F.coalesce(F.coalesce("component_id", key) == F.col(key), F.lit(False)).alias("kept")))
