"""Gradient-boosted trees on binned features, fitted on all rows.

Columns are cut into bins at exact quantiles of all rows, and several columns share one 16-bit number of a row. Up to `TASK_ROWS` rows
a model is fitted by one task, all models of a set at once. More rows stay dealt out over tasks: a job counts the leaves of all models
that may be cut next, and only histograms come to the driver. Gradients are rounded so that their sums are exact: both ways give
the same trees, whatever the number of tasks.
An ensemble is a node table; scoring and attribution walk it over all rows in parallel.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import checkpointed

NODES = "model string, tree int, node int, left int, right int, feature int, threshold double, value double"
TASK_ROWS = 1_000_000  # a model of more rows is fitted by many tasks; this is no limit to the rows used
BINS = 64
CELLS = 4096  # most combinations of bins of the columns that share a number
KEPT = 25  # after so many trees the scores are stored, which cuts their lineage
ROOT = -1  # the tree number under which a model's base score is kept


@dataclass(frozen=True)
class Growth:
    """How trees grow: best leaf first, up to `leaves`."""

    rounds: int
    leaves: int = 31
    rate: float = 0.05
    least_rows: int = 30
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42


# --- bins ---------------------------------------------------------------------------------------------------

def _ranks(n: int) -> list[int]:
    """Which of n sorted values are upper borders of bins; the last one is the greatest."""
    return sorted({(n - 1) * k // BINS for k in range(1, BINS + 1)})


def borders_of(x: np.ndarray) -> list[np.ndarray]:
    """Upper borders of every column's bins, by quantiles of its values."""
    out = []
    for column in (x + 0.0).T:
        values = np.unique(column)
        out.append(values if len(values) <= BINS else np.unique(np.sort(column)[_ranks(len(column))]))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0)) + 0.0  # no negative zeros
            found = [np.unique(column, return_counts=True) for column in x.T]
            columns = np.repeat(np.arange(len(found), dtype=np.int32), [len(v) for v, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(columns), pa.array(np.concatenate([v for v, _ in found])),
                                              pa.array(np.concatenate([c for _, c in found]))], ["column", "value", "n"])


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def exact_borders(x: DataFrame, width: int) -> tuple[list[np.ndarray], int]:
    """(what `borders_of` gives for the arrays in a frame's only column, the number of rows). At most `BINS` values of each column and
    one row for each range of values come to the driver."""
    found = x.mapInArrow(_counted, "column int, value double, n bigint").groupBy("column", "value").agg(F.sum("n").alias("n"))
    found = checkpointed(found.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()))
    parts = sorted(found.groupBy("column", "part").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values")).collect())
    rows = sum(p.rows for p in parts if p.column == 0)
    if not rows:
        return [np.empty(0)] * width, 0
    values, seen, before = [0] * width, [0] * width, []
    for p in parts:
        before.append((p.column, p.part, seen[p.column]))
        seen[p.column] += p.rows
        values[p.column] += p.values
    few = F.array(*[F.lit(v <= BINS) for v in values])
    running = F.sum("n").over(Window.partitionBy("column", "part").orderBy("value")) + F.col("before")
    table = x.sparkSession.createDataFrame(before, "column int, part int, before bigint")
    placed = found.join(F.broadcast(table), ["column", "part"]).withColumn("upto", running)
    ranks = F.array(*[F.lit(r).cast("bigint") for r in _ranks(rows)])
    hit = F.exists(ranks, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    chosen = placed.filter(F.get(few, "column") | hit).select("column", "value").collect()
    out: list[list[float]] = [[] for _ in range(width)]
    for column, value in chosen:
        out[column].append(value)
    return [np.sort(np.array(v)) for v in out], rows


@dataclass(frozen=True)
class Packing:
    """Which columns share a 16-bit number of a row. A column with one value can part no rows and has no place."""

    borders: list[np.ndarray]
    groups: list[list[int]]
    columns: list[int]  # those that have a place

    @classmethod
    def of(cls, borders: list[np.ndarray], rows: int) -> "Packing":
        cells = min(max(rows // 64, BINS), CELLS)  # few rows are not worth many combinations
        groups: list[list[int]] = []
        sizes: list[int] = []
        for k in sorted((k for k, b in enumerate(borders) if len(b) > 1), key=lambda k: -len(borders[k])):
            i = next((i for i, size in enumerate(sizes) if size * len(borders[k]) <= cells), len(sizes))
            if i == len(sizes):
                groups.append([])
                sizes.append(1)
            groups[i].append(k)
            sizes[i] *= len(borders[k])
        return cls(borders, groups, sorted(k for group in groups for k in group))

    @property
    def filled(self) -> np.ndarray:
        """Which places of a histogram are used."""
        return np.arange(BINS) < np.array([*(len(self.borders[k]) for k in self.columns), 1])[:, None]

    def shape(self, group: list[int]) -> list[int]:
        return [len(self.borders[k]) for k in group]

    def packed(self, x: np.ndarray) -> np.ndarray:
        """The numbers of every row, one line per group."""
        out = np.zeros((len(self.groups), len(x)), np.uint16)
        for line, group in zip(out, self.groups, strict=True):
            for k in group:
                line *= np.uint16(len(self.borders[k]))
                line += np.minimum(np.searchsorted(self.borders[k], x[:, k] + 0.0, "left"), len(self.borders[k]) - 1).astype(np.uint16)
        return out

    def lower(self, column: int, cut: int) -> tuple[int, np.ndarray]:
        """(the line that has a column, whether each number on it lies at or below a cut)."""
        i = next(i for i, group in enumerate(self.groups) if column in group)
        sizes, at = self.shape(self.groups[i]), self.groups[i].index(column)
        return i, np.arange(math.prod(sizes)) // math.prod(sizes[at + 1:]) % sizes[at] <= cut


# --- trees --------------------------------------------------------------------------------------------------

@dataclass
class _Block:
    """Rows of one task and the leaves of one tree that they are in."""

    packing: Packing
    packed: np.ndarray
    g: np.ndarray
    h: np.ndarray
    drawn: np.ndarray  # rows that count in this tree; the others only go to their leaves
    rows: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, packing: Packing, packed: np.ndarray, y: np.ndarray, score: np.ndarray, drawn: np.ndarray, bits: int) -> "_Block":
        p = 1 / (1 + np.exp(-score))
        unit = 2.0 ** bits
        return cls(packing, packed, np.rint((p - y) * unit) / unit, np.rint(p * (1 - p) * unit) / unit, drawn, {0: np.arange(len(y))})

    def histogram(self, leaf: int) -> np.ndarray:
        """Sums of gradients, of their slopes and of rows by (column, bin); the sums of all rows lie behind the last column."""
        rows = self.rows[leaf]
        rows = rows[self.drawn.take(rows)]
        g, h, columns = self.g.take(rows), self.h.take(rows), self.packing.columns
        out = np.zeros((3, len(columns) + 1, BINS))
        out[:, -1, 0] = g.sum(), h.sum(), len(rows)
        for line, group in zip(self.packed, self.packing.groups, strict=True):
            shape = self.packing.shape(group)
            cells, size = line.take(rows).astype(np.intp), math.prod(shape)
            counts = np.stack([np.bincount(cells, g, size), np.bincount(cells, h, size), np.bincount(cells, minlength=size)]).reshape(3, *shape)
            for i, k in enumerate(group):
                out[:, columns.index(k), :shape[i]] = counts.sum(tuple(a + 1 for a in range(len(shape)) if a != i))
        return out

    def values(self, ends: dict[int, float]) -> np.ndarray:
        out = np.empty(len(self.g))
        for leaf, rows in self.rows.items():
            out[rows] = ends[leaf]
        return out

    def part(self, leaf: int, column: int, cut: int, left: int, right: int) -> None:
        line, lower = self.packing.lower(column, cut)
        rows = self.rows.pop(leaf)
        goes = lower.take(self.packed[line].take(rows))
        self.rows[left], self.rows[right] = rows[goes], rows[~goes]


class _Tree:
    """A tree as it grows. Leaves can be cut ahead of their turn, so that one pass over the rows serves several; `grown` takes the cuts
    in their order."""

    def __init__(self, packing: Packing, chosen: np.ndarray, how: Growth, root: np.ndarray):
        self.packing, self.how = packing, how
        self.open = np.append(np.isin(packing.columns, chosen), False)[:, None]
        self.value: list[float] = []
        self.best: list[tuple[float, int, int, bool]] = []
        self.hist: dict[int, np.ndarray] = {}
        self.cuts: dict[int, tuple[int, int, int, int, int]] = {}  # leaf, column, bin, children
        self._add(root)

    def _add(self, hist: np.ndarray) -> None:
        """Keep a leaf's value and best cut: gain, column's place, bin, whether its lower side has fewer rows."""
        self.value.append(float(-self.how.rate * hist[0, -1, 0] / max(hist[1, -1, 0], 1e-12)))
        left = np.cumsum(hist, 2)
        whole = hist[:, -1:, :1]
        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
        fits = (left[2] >= self.how.least_rows) & (right[2] >= self.how.least_rows) & (left[1] > 1e-3) & (right[1] > 1e-3) & self.open
        gain = np.where(fits, gain, -np.inf)
        k, cut = divmod(int(np.argmax(gain)), BINS)
        self.hist[len(self.value) - 1] = hist
        self.best.append((float(gain[k, cut]), k, cut, bool(left[2, k, cut] <= right[2, k, cut])))

    def grown(self) -> tuple[list[list], list[int], list[int]]:
        """(nodes as [left, right, feature, threshold, value], the leaf that each was, leaves to be cut before it can go on)."""
        nodes, was = [[-1, -1, -1, 0.0, self.value[0]]], [0]
        heap, leaves = [(-self.best[0][0], 0)], 1
        while heap and leaves < self.how.leaves:
            gain, node = heapq.heappop(heap)
            if not np.isfinite(gain) or -gain <= 1e-9:
                break
            if was[node] not in self.cuts:
                later = [n for g, n in heapq.nsmallest(self.how.leaves - leaves - 1, heap) if -g > 1e-9]
                return nodes, was, [was[n] for n in [node, *later] if was[n] not in self.cuts]
            _, column, cut, *children = self.cuts[was[node]]
            nodes[node][:4] = [len(nodes), len(nodes) + 1, column, float(self.packing.borders[column][cut])]
            for child in children:
                heapq.heappush(heap, (-self.best[child][0], len(nodes)))
                nodes.append([-1, -1, -1, 0.0, self.value[child]])
                was.append(child)
            leaves += 1
        return nodes, was, []

    def cut(self, leaf: int) -> tuple[tuple[int, int, int, int, int], int]:
        """(how a leaf is parted, its child with fewer rows): only that one is counted, the other is the difference."""
        _, place, cut, lower_is_small = self.best[leaf]
        left = 1 + 2 * len(self.cuts)
        self.cuts[leaf] = (leaf, self.packing.columns[place], cut, left, left + 1)
        return self.cuts[leaf], left if lower_is_small else left + 1

    def counted(self, leaf: int, small: int, hist: np.ndarray) -> None:
        other = self.hist.pop(leaf) - hist
        for h in (hist, other) if small == self.cuts[leaf][3] else (other, hist):
            self._add(h)

    def ends(self, was: list[int]) -> dict[int, float]:
        """What the tree adds to the rows of every leaf there is; one that was cut in vain passes its value on. `was`: see `grown`."""
        out, taken = {}, set(was)
        todo = [(leaf, self.value[leaf]) for leaf in was if leaf not in self.cuts or self.cuts[leaf][3] not in taken]
        while todo:
            leaf, value = todo.pop()
            if leaf in self.cuts:
                todo += [(child, value) for child in self.cuts[leaf][3:]]
            else:
                out[leaf] = value
        return out


class _Draws:
    """Which rows and columns each tree sees. A task draws only for its own rows: the generator is moved to the first of them."""

    def __init__(self, seed: int):
        self.bits = np.random.PCG64(seed)

    def next(self, n: int, width: int, share: float) -> tuple[dict, np.ndarray]:
        """(state from which n rows are drawn, columns)."""
        state = self.bits.state
        self.bits.state = _moved(state, n)
        return state, np.sort(np.random.Generator(self.bits).permutation(width)[:max(1, round(share * width))])


def _moved(state: dict, n: int) -> dict:
    """A generator's state after n draws of a double."""
    bits = np.random.PCG64()
    bits.state = state
    return {**bits.advance(n).state, "has_uint32": state["has_uint32"], "uinteger": state["uinteger"]}


def _drawn(state: dict, first: int, n: int, share: float) -> np.ndarray:
    bits = np.random.PCG64()
    bits.state = _moved(state, first)
    return np.random.Generator(bits).random(n) < share


def _base(mean: float) -> float:
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def _exact_bits(n: int) -> int:
    """Sums of n numbers of at most 1 are exact if these are multiples of 2 to the minus this."""
    return 52 - n.bit_length()


def _here(packing: Packing, packed: np.ndarray, y: np.ndarray, how: Growth) -> list[tuple]:
    """(tree, node, left, right, feature, threshold, value) of a model whose rows are all here, in their order."""
    n, base, draws = len(y), _base(float(y.mean())), _Draws(how.seed)
    out: list[tuple] = [(ROOT, 0, -1, -1, -1, 0.0, base)]
    score = np.full(n, base)
    for number in range(how.rounds):
        state, chosen = draws.next(n, len(packing.borders), how.column_share)
        block = _Block.of(packing, packed, y, score, _drawn(state, 0, n, how.row_share), _exact_bits(n))
        tree = _Tree(packing, chosen, how, block.histogram(0))
        while (found := tree.grown())[2]:
            leaf = found[2][0]
            parted, small = tree.cut(leaf)
            block.part(*parted)
            tree.counted(leaf, small, block.histogram(small))
        score += block.values(tree.ends(found[1]))
        out += [(number, i, *node) for i, node in enumerate(found[0])]
    return out


def fitted(x: np.ndarray, y: np.ndarray, how: Growth) -> list[tuple]:
    """(tree, node, left, right, feature, threshold, value) of an ensemble for the log odds of y."""
    packing = Packing.of(borders_of(x), len(x))
    return _here(packing, packing.packed(x), y, how)


# --- rows of a frame ----------------------------------------------------------------------------------------

def _one_each(models: int, frame: DataFrame) -> list[int]:
    """A number for each model, such that no two of them are dealt to one task."""
    places = frame.sparkSession.range(40 * models).select("id", F.pmod(F.hash("id"), F.lit(models)).alias("p"))
    found = {p: i for i, p in places.orderBy(F.desc("id")).collect()}
    return [found.get(i, i) for i in range(models)]


def _apart(rows: DataFrame, packing: Packing, labels: Sequence[str], how: Growth) -> DataFrame:
    """Every model by its own task."""
    names = dict(zip(_one_each(len(labels), rows), labels, strict=True))
    each = F.explode(F.array(*[F.struct(F.lit(deal).cast("bigint").alias("deal"), F.get("ys", k).alias("y")) for k, deal in enumerate(names)]))
    wide = rows.select("place", "tie", "cells", each.alias("_l")).select("_l.deal", "place", "tie", "cells", "_l.y")

    def grow(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("tie").to_numpy(), table.column("place").to_numpy()))
        nodes = _here(packing, _lines(table.column("cells"), len(packing.groups))[:, order], table.column("y").to_numpy()[order], how)
        columns = list(zip(*nodes, strict=True))
        kinds = [pa.int32()] * 5 + [pa.float64()] * 2
        arrays = [pa.array([names[table.column("deal")[0].as_py()]] * len(nodes))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.Table.from_arrays(arrays, names=[c.split()[0] for c in NODES.split(", ")])

    return wide.repartition(len(labels), "deal").groupBy("deal").applyInArrow(grow, NODES)


def _lines(cells: pa.Array | pa.ChunkedArray, groups: int) -> np.ndarray:
    """One line per group from one binary value per row."""
    chunks = cells.chunks if isinstance(cells, pa.ChunkedArray) else [cells]
    out = np.empty((groups, len(cells)), np.uint16)
    first = 0
    for chunk in chunks:
        if groups and len(chunk):
            at = np.frombuffer(chunk.buffers()[1], np.int32, 1, 4 * chunk.offset)[0]
            values = np.frombuffer(chunk.buffers()[2], np.uint16, groups * len(chunk), at)
            out[:, first:first + len(chunk)] = values.reshape(-1, groups).T
        first += len(chunk)
    return out


def _spread(rows: DataFrame, n: int, tasks: int, packing: Packing, labels: Sequence[str], how: Growth) -> list[tuple]:
    """All models together, rows dealt out over tasks by their place: a job for every step of the trees that grow."""
    groups, models = len(packing.groups), len(labels)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(_lines(b.column("cells"), groups), _matrix(b.column("ys")).T) for b in batches if b.num_rows]
        lines = np.concatenate([a for a, _ in held], 1) if held else np.empty((groups, 0), np.uint16)
        ys = np.concatenate([y for _, y in held], 1) if held else np.empty((models, 0))
        yield pa.RecordBatch.from_pydict({"lines": pa.array([lines.tobytes()], pa.binary()), "ys": pa.array([ys.tobytes()], pa.binary())})

    dealt = rows.repartitionByRange(tasks, "place").sortWithinPartitions("place", "tie")
    stored = checkpointed(dealt.mapInArrow(block, "lines binary, ys binary")).rdd.map(lambda r: (
        np.frombuffer(r.ys, float).reshape(models, -1), np.frombuffer(r.lines, np.uint16))).map(lambda b: (b[1].reshape(groups, b[0].shape[1]), b[0]))
    one = BatchedSerializer(CPickleSerializer(), 1)  # both sides of a zip are read block by block
    blocks = stored._reserialize(one).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = blocks.mapPartitionsWithIndex(lambda part, found: [(part, b[1].shape[1], b[1].sum(1)) for b in found]).collect()
    firsts = {part: sum(size for before, size, _ in sizes if before < part) for part, _, _ in sizes}
    bases = [_base(float(sum(s[k] for _, _, s in sizes)) / n) for k in range(models)]
    reducers, bits = min(tasks, rows.sparkSession.sparkContext.defaultParallelism), _exact_bits(n)
    scores = blocks.map(lambda b: np.repeat(np.array(bases)[:, None], b[1].shape[1], 1))._reserialize(one).persist(StorageLevel.MEMORY_AND_DISK)
    out: list[tuple] = [(c, ROOT, 0, -1, -1, -1, 0.0, base) for c, base in zip(labels, bases, strict=True)]
    draws, share = _Draws(how.seed), how.row_share

    def here(part: int, block: tuple, score: np.ndarray, state: dict, k: int, cuts: list) -> _Block:
        lines, ys = block
        drawn = _drawn(state, firsts[part], ys.shape[1], share)
        found = _Block.of(packing, lines, ys[k], score[k], drawn, bits)
        for cut in cuts:
            found.part(*cut)
        return found

    def sums(scores: RDD, state: dict, asked: dict[int, tuple[list, list[int]]]) -> dict[tuple[int, int], np.ndarray]:
        """Histograms by (model, leaf); without the bins that a column does not have on their way here."""
        def count(part: int, pairs: Iterator) -> Iterator:
            for block, score in pairs:
                for k, (cuts, leaves) in asked.items():
                    found = here(part, block, score, state, k, cuts)
                    yield from (((k, leaf), found.histogram(leaf)[:, packing.filled]) for leaf in leaves)

        whole, keys = {}, sum(len(leaves) for _, leaves in asked.values())
        for at, hist in blocks.zip(scores).mapPartitionsWithIndex(count).reduceByKey(np.add, min(reducers, keys)).collect():
            whole[at] = np.zeros((3, *packing.filled.shape))
            whole[at][:, packing.filled] = hist
        return whole

    def added(scores: RDD, state: dict, ends: list[tuple[list, dict[int, float]]]) -> RDD:
        def add(part: int, pairs: Iterator) -> Iterator:
            for block, score in pairs:
                yield np.stack([score[k] + here(part, block, score, state, k, cuts).values(found) for k, (cuts, found) in enumerate(ends)])

        return blocks.zip(scores).mapPartitionsWithIndex(add)._reserialize(one).persist(StorageLevel.MEMORY_AND_DISK)

    older = None
    for number in range(how.rounds):
        state, chosen = draws.next(n, len(packing.borders), how.column_share)
        roots = sums(scores, state, {k: ([], [0]) for k in range(models)})
        if older is not None:
            older.unpersist()
        trees = [_Tree(packing, chosen, how, roots[k, 0]) for k in range(models)]
        while waiting := {k: w for k, t in enumerate(trees) if (w := t.grown()[2])}:
            small = {k: {leaf: trees[k].cut(leaf)[1] for leaf in leaves} for k, leaves in waiting.items()}
            found = sums(scores, state, {k: (list(trees[k].cuts.values()), list(s.values())) for k, s in small.items()})
            for k, s in small.items():
                for leaf, child in s.items():
                    trees[k].counted(leaf, child, found[k, child])
        ends = []
        for label, tree in zip(labels, trees, strict=True):
            nodes, was, _ = tree.grown()
            out += [(label, number, i, *node) for i, node in enumerate(nodes)]
            ends.append((list(tree.cuts.values()), tree.ends(was)))
        older, scores = scores, added(scores, state, ends)
        if number % KEPT == KEPT - 1:
            scores.checkpoint()
    for held in (older, scores, blocks):
        if held is not None:
            held.unpersist()
    return out


def fit(frame: DataFrame, key: str, features: Sequence[str], labels: Sequence[str], how: Growth, task_rows: int = TASK_ROWS) -> DataFrame:
    """The node tables of one model per label column, from all rows. Up to `task_rows` rows a model is one task; the trees are the same."""
    spark = frame.sparkSession
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = frame.select(F.xxhash64(key, *features).alias("place"), F.xxhash64(*labels).alias("tie"), x.alias("x"), F.array(*[F.col(c).cast("double") for c in labels]).alias("ys"))
    borders, n = exact_borders(rows.select("x"), len(features))
    if not n:
        return spark.createDataFrame([], NODES)
    packing = Packing.of(borders, n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.ascontiguousarray(packing.packed(_matrix(batch.column("x"))).T)
                ends = np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(cells.shape[1] * cells.itemsize)
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(cells)])
                yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("tie"), packed, batch.column("ys")], ["place", "tie", "cells", "ys"])

    packed = rows.mapInArrow(pack, "place bigint, tie bigint, cells binary, ys array<double>")
    if n <= task_rows:
        return _apart(packed, packing, labels, how)
    tasks = max(-(-n // task_rows), spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(_spread(packed, n, tasks, packing, labels, how), NODES)


# --- scoring ------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class FlatTree:
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class LeafTable:
    """Which leaf of a tree a row ends in, by table instead of by walk. A row has a place among the borders of each feature; for each
    feature of the tree and each place there, a table has the leaves that are left as bits, leftmost leaf lowest. The lowest bit left
    over all features is the row's leaf."""

    masks: list[tuple[int, np.ndarray]]  # feature, bits by place
    value: np.ndarray  # of every node
    leaves: np.ndarray  # their nodes, from the left
    moves: list[tuple[int, np.ndarray]]  # feature, how far it moves the score on the way to every leaf

    @classmethod
    def of(cls, t: FlatTree, borders: dict[int, np.ndarray]) -> "LeafTable":
        leaves: list[int] = []
        ways: list[dict[int, float]] = []
        cut: list[tuple[int, int]] = []  # inner node, bits of the leaves left of its cut
        todo: list[tuple] = [("enter", 0, {})]
        while todo:
            what, node, told = todo.pop()
            if what == "middle":
                cut.append((node, (1 << len(leaves)) - (1 << told)))
            elif t.left[node] < 0:
                leaves.append(node)
                ways.append(told)
            else:
                f = int(t.feature[node])
                step = lambda child: {**told, f: told.get(f, 0.0) + float(t.value[child] - t.value[node])}  # noqa: B023, E731
                todo += [("enter", t.right[node], step(t.right[node])), ("middle", node, len(leaves)), ("enter", t.left[node], step(t.left[node]))]
        kind = np.uint32 if len(leaves) <= 32 else np.uint64
        every = (1 << 8 * np.dtype(kind).itemsize) - 1
        if len(leaves) > 64:
            kind, every = object, (1 << len(leaves)) - 1  # whole numbers of any length: slow, but as exact
        masks: dict[int, np.ndarray] = {}
        for node, bits in cut:
            f = int(t.feature[node])
            table = masks.setdefault(f, np.full(len(borders[f]) + 1, every, kind))
            beyond = np.searchsorted(borders[f], t.threshold[node], "left") + 1
            table[beyond:] &= kind(every ^ bits) if kind is not object else every ^ bits
        moves = [(f, np.array([w.get(f, 0.0) for w in ways])) for f in masks]
        return cls(list(masks.items()), t.value, np.array(leaves), moves)

    def leaf(self, places: dict[int, np.ndarray], n: int) -> np.ndarray:
        """The number of the leaf, from the left, of each of n rows."""
        if not self.masks:
            return np.zeros(n, np.intp)
        (f, table), *others = self.masks
        left = table.take(places[f])
        for f, table in others:
            left &= table.take(places[f])
        if left.dtype == object:
            return np.array([(int(b) & -int(b)).bit_length() - 1 for b in left], np.intp)
        lowest = left & (~left + left.dtype.type(1))
        return (lowest.astype(float).view(np.int64) >> 52) - 1023  # the exponent: a power of two is exact as a float


@dataclass(frozen=True)
class Ensemble:
    """The trees of one model as leaf tables; its size is set by the growth, not by the data."""

    base: float
    trees: list[LeafTable]
    borders: dict[int, np.ndarray]  # thresholds of every feature, of all models that were fitted together

    def places(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Between which borders the rows lie, by feature; the same for all models that were fitted together."""
        columns = np.ascontiguousarray(x.T)
        return {f: np.searchsorted(b, columns[f], "left") for f, b in self.borders.items()}

    def score(self, x: np.ndarray, places: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Log odds of every row."""
        places = self.places(x) if places is None else places
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaves].take(t.leaf(places, len(x)))
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """How far each feature moved each row's score on its way through the trees."""
        places, out = self.places(x), np.zeros((x.shape[1], len(x)))
        for t in self.trees:
            leaf = t.leaf(places, len(x))
            for f, moved in t.moves:
                out[f] += moved.take(leaf)
        return np.ascontiguousarray(out.T)


def ensembles(nodes: DataFrame) -> dict[str, Ensemble]:
    """Every model of a node table. Its rows are bounded by rounds x nodes of a tree x models."""
    table = nodes.toPandas().sort_values(["model", "tree", "node"])
    inner = table[table["left"] >= 0]
    borders = {int(f): np.unique(t.to_numpy()) for f, t in inner.groupby("feature")["threshold"]}
    out: dict[str, Ensemble] = {}
    for name, rows in table.groupby("model"):
        base = float(rows.loc[rows["tree"] == ROOT, "value"].sum())
        trees = [FlatTree(*(t[c].to_numpy() for c in ("left", "right", "feature", "threshold", "value"))) for n, t in rows.groupby("tree") if n != ROOT]
        out[str(name)] = Ensemble(base, [LeafTable.of(t, borders) for t in trees], borders)
    return out
