"""Order-dependent rules with feedback, made parallel.

State machines: a request is a map over the states, and maps compose, so a long history is cut into chunks, every chunk is
composed on its own, and one map per chunk is carried over. Budgets: what a chunk accepts depends on the few acceptances before
it, so all chunks are worked out at once, and again only where the entry turns out to be another one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.operators.ordered import CHUNK, split_hot
from waymark.session import checkpointed

ARRAY_ROWS = 200_000  # rows of one key and chunk that are held as one sorted array


# --- state machines ------------------------------------------------------------------------------------------

def machine(states: Sequence[str], moves: Mapping[str, tuple[Sequence[str], str | None]], action: Column) -> Column:
    """The action's map over the states as an array of targets: allowed states go to the target, the others stay. An unknown
    action changes nothing."""
    stay = list(range(len(states)))
    out = F.array(*[F.lit(i) for i in stay])
    for name, (allowed, target) in moves.items():
        to = [states.index(target) if target and s in allowed else i for i, s in enumerate(states)]
        out = F.when(action == name, F.array(*[F.lit(i) for i in to])).otherwise(out)
    return out


def then(first: Column, second: Column) -> Column:
    """The map of `first`, then `second`."""
    return F.transform(first, lambda s: F.get(second, s))


def _running(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Composition of all maps of a group up to each row, in log rounds; `first` is the row its group begins at."""
    out, row, step = maps.copy(), np.arange(len(maps)), 1
    while step < len(maps):
        reach = row - step >= first
        if not reach.any():
            break
        out[reach] = np.take_along_axis(out[reach], out[row[reach] - step], 1)
        step *= 2
    return out


def _composed(df: DataFrame, part: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carried = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            maps = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            fresh = np.zeros(n, bool)
            for c in part:
                codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                fresh[1:] |= codes[1:] != codes[:-1]
            here = tuple(batch.column(c)[0].as_py() for c in part)
            fresh[0] = True
            stay = np.arange(maps.shape[1])
            # the group that goes on from the batch before starts with what that one ended with
            entry = carried if here == key else stay
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            maps[0] = maps[0][entry]
            upto = _running(maps, first)
            before = np.where(fresh[:, None], stay, np.roll(upto, 1, 0))
            before[0] = entry
            key, carried = tuple(batch.column(c)[n - 1].as_py() for c in part), upto[-1]
            lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * maps.shape[1], maps.shape[1], dtype=np.int32),
                                             pa.array(before.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, lists], arrow, strict=True)], schema=arrow)

    return df.repartition(*part).sortWithinPartitions(*part, *order).mapInArrow(run, schema)


def composed_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """Add `name`: the composition of the maps in `column` over the rows before each row of its key.

    With a `chunk` column (see split_hot) every (key, chunk) is composed apart, and the chunks' own maps, one row each, are
    composed by the same function and put in front.
    """
    if CHUNK not in df.columns or CHUNK in keys:
        return _composed(df, keys, order, column, name)
    part = [*keys, CHUNK]
    inside = _composed(df, part, order, column, name)
    ends = inside.filter(F.col(CHUNK) >= 0).groupBy(*part).agg(F.max_by(F.struct(name, column), F.struct(*order)).alias("_last"))
    whole = ends.select(*part, then(F.col(f"_last.{name}"), F.col(f"_last.{column}")).alias(column))
    carry = checkpointed(_composed(whole, list(keys), [CHUNK], column, "_carry").select(*part, "_carry"))
    joined = inside.join(carry, part, "left")
    return joined.withColumn(name, F.coalesce(then(F.col("_carry"), F.col(name)), F.col(name))).drop("_carry")


# --- budgets -------------------------------------------------------------------------------------------------

def accepted_of(times: np.ndarray, fixed: np.ndarray, entry: Sequence[int], allowed: int, span: int) -> tuple[list[int], list[int]]:
    """(places accepted, the last acceptances): fewer than `allowed` acceptances lie less than `span` before an accepted row.

    Jumps from acceptance to acceptance: the next one is the first row a span after the `allowed`-last. Fixed rows are accepted
    as they are and count. The rows between are never looked at.
    """
    recent, done, i, n = list(entry), [], 0, len(times)
    given = np.flatnonzero(fixed).tolist()
    g = 0
    while i < n:
        if allowed <= 0:
            j = n
        elif len(recent) < allowed:
            j = i
        else:
            j = max(i, int(np.searchsorted(times, recent[-allowed] + span)))
        while g < len(given) and given[g] < i:
            g += 1
        if g < len(given) and given[g] <= j:
            j = given[g]
        elif j < n:
            done.append(j)
        else:
            break
        recent.append(int(times[j]))
        i = j + 1
    return done, recent[-allowed:] if allowed > 0 else []


def budgeted(rows: DataFrame, key: str, ident: str, at: str, fixed: str, allowed: int, span: int, limit: int, max_chunks: int) -> DataFrame:
    """(ident, key, accepted) of the rows that are not fixed: a budget of `allowed` acceptances in every `span` before a row.

    One exchange: a key's rows become a sorted array, a hot key's rows one for each chunk of its time line. All chunks start
    from an empty entry; while a chunk's entry, the last acceptances of the chunk before it, is another one, it is done again.
    A budget forgets its past quickly, so this settles after few rounds; after as many rounds as a key has chunks it must have.
    """
    cut = split_hot(rows, [key], at, min(limit, ARRAY_ROWS), max_chunks)
    hot = CHUNK in cut.columns
    part = [key, CHUNK] if hot else [key]
    listed = cut.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("_at", ident, fixed))).alias("rows"))
    kind = rows.schema[ident].dataType.simpleString()
    entry = F.array().cast("array<bigint>")
    if not hot:
        return _judged(listed.withColumn("entry", entry), key, ident, kind, fixed, allowed, span)
    stored = checkpointed(listed)
    ends = checkpointed(_ends(stored.withColumn("entry", entry), part, fixed, allowed, span))
    while True:
        before = Window.partitionBy(key).orderBy(CHUNK)
        entered = ends.withColumn("next", F.coalesce(F.lag("exit").over(before), entry))
        moved = checkpointed(entered.filter(~F.col("next").eqNullSafe(F.col("entry"))).select(*part, F.col("next").alias("entry")))
        if moved.isEmpty():
            break
        again = _ends(stored.join(moved, part), part, fixed, allowed, span)
        ends = checkpointed(ends.join(moved, part, "left_anti").unionByName(again))
    return _judged(stored.join(ends.select(*part, "entry"), part), key, ident, kind, fixed, allowed, span)


def _times(column: pa.Array, k: int, fixed: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    row = column[k].values
    times = row.field("_at").to_numpy(zero_copy_only=False)
    return times, row.field(fixed).to_numpy(zero_copy_only=False), row


def _ends(df: DataFrame, part: Sequence[str], fixed: str, allowed: int, span: int) -> DataFrame:
    """(part, entry, exit): the last acceptances before and after each chunk."""
    source = df.select(*part, "entry", "rows")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("exit", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, lists = batch.column("entry").to_pylist(), batch.column("rows")
            exits = [accepted_of(*_times(lists, k, fixed)[:2], entries[k], allowed, span)[1] for k in range(batch.num_rows)]
            columns = [*batch.columns[:-1], pa.array(exits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, schema)


def _judged(df: DataFrame, key: str, ident: str, kind: str, fixed: str, allowed: int, span: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, entries, lists = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            parts = []
            for k in range(batch.num_rows):
                times, given, row = _times(lists, k, fixed)
                verdict = np.zeros(len(times), bool)
                verdict[accepted_of(times, given, entries[k], allowed, span)[0]] = True
                own = pa.array(~given.astype(bool))
                parts.append((row.field(ident).filter(own), pa.repeat(keys[k], len(times)).filter(own), pa.array(verdict).filter(own)))
            if parts:
                columns = [pa.concat_arrays(list(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[ident, key, "accepted"])

    return df.select(key, "entry", "rows").mapInArrow(run, f"{ident} {kind}, {key} {df.schema[key].dataType.simpleString()}, accepted boolean")
