"""Suffix-array dedup: long byte strings that occur more than once are found with sharded suffix arrays and removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BASE, Hasher, mix, ragged, released, slices, text_buffer, with_arrow_columns
from waymark.llm.suffix_array import common_prefixes, suffix_array
from waymark.session import checkpointed

LENGTH = 200
GRAM = 24  # bytes of an anchor
PIECE = 1 << 20  # bytes of text that are cut, and of distinct text that is sorted, at a time
HOT_BYTES = 2 << 20  # distinct text of one anchor beyond which its windows are dealt out by further anchors
FURTHER = 8
PLACE = np.uint64((1 << 28) - 1)


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, length: int) -> np.ndarray:
    """For every window start the place of its anchor: the gram of least hash, the leftmost of equal ones."""
    ranked = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    return (window_least(ranked, length - GRAM + 1) & PLACE).astype(np.int64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    at = np.arange(len(data) - GRAM + 1)
    return Hasher(data)(at, at + GRAM)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, number of the text, place in the text) of runs of whole texts; a very long text comes in overlapping parts
    that have every window once."""
    for low, high in slices(offsets, PIECE):
        if offsets[high] - offsets[low] <= 2 * PIECE:
            yield data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], np.arange(low, high), np.zeros(high - low, np.int64)
            continue
        for at in range(int(offsets[low]), int(offsets[high]) - length + 1, PIECE):
            part = data[at:min(at + PIECE + length - 1, int(offsets[high]))]
            yield part, np.array([0, len(part)]), np.array([low]), np.array([at - offsets[low]])


def segments(docs: DataFrame, length: int) -> DataFrame:
    """(_id, _t, pos, key, h): runs of windows with the same anchor. docs has _id, _t and text.

    pos holds the first window's place in the text and the number of windows, key the anchor's hash, h a hash of the bytes the
    windows cover. Equal windows have equal anchors, so a window that occurs again does so under the same key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for part, bounds, number, place in pieces(data, offsets, length):
                windows = np.maximum(np.diff(bounds) - length + 1, 0)
                if not windows.sum():
                    continue
                starts = ragged(bounds[:-1], windows)
                hashed = Hasher(part)
                at = np.arange(len(part) - GRAM + 1)
                grams = hashed(at, at + GRAM)
                anchor = anchors(grams, length)[starts]
                first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                count = np.diff(np.append(first, len(anchor)))
                low = starts[first]
                own = np.searchsorted(bounds, low, "right") - 1
                rows = pa.array(number[own])
                h = hashed(low, low + count - 1 + length)
                pos = (low - bounds[own] + place[own]) << 32 | count
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(rows), batch.column("_t").take(rows), pa.array(pos),
                                                  pa.array(grams[anchor[first]].view(np.int64)), pa.array(h.view(np.int64))],
                                                 names=["_id", "_t", "pos", "key", "h"])

    kind = dict(docs.dtypes)["_id"]
    return docs.select("_id", "_t", "text").mapInArrow(released(run), f"_id {kind}, _t bigint, pos bigint, key bigint, h bigint")


def subdivide(data: np.ndarray, count: int, length: int) -> list[tuple[int, int, int]]:
    """(first window, number of windows, key) of runs of windows that share the anchors of FURTHER other hash functions."""
    grams = gram_hashes(data)
    change = np.zeros(count, bool)
    change[0] = True
    key = np.zeros(count, np.uint64)
    for f in range(FURTHER):
        other = mix(grams ^ (BASE * np.uint64(f + 1)))
        anchor = anchors(other, length)[:count]
        change[1:] |= anchor[1:] != anchor[:-1]
        key = mix(key * BASE + other[anchor])
    first = np.flatnonzero(change)
    return list(zip(first.tolist(), np.diff(np.append(first, count)).tolist(), key[first].view(np.int64).tolist(), strict=True))


OUT = "shard bigint, th bigint, key bigint, h bigint, cnt bigint, sub int, starts int, many boolean, bytes binary"


def cut(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments. texts has text and _segs, a document's (key, h, cnt, lo, many, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("th", pa.int64()), ("key", pa.int64()), ("h", pa.int64()), ("cnt", pa.int64()),
                            ("sub", pa.int32()), ("starts", pa.int32()), ("many", pa.bool_()), ("bytes", pa.binary())])
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            raw = columns.pop()
            data, lengths = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
            ends = np.cumsum(lengths)
            th = Hasher(np.frombuffer(data, np.uint8))(ends - lengths, ends).view(np.int64)
            shard, *others = columns
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([shard, th, *others, raw], schema, strict=True)], schema=schema)

        for batch in batches:
            text, lists = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()), batch.column(batch.schema.get_field_index("_segs"))
            for i in range(batch.num_rows):
                raw = text[i].as_py() or b""
                for s in lists[i].as_py():
                    part = raw[s["lo"]:s["lo"] + s["cnt"] - 1 + length]
                    subs = subdivide(np.frombuffer(part, np.uint8), s["cnt"], length) if s["hot"] else [(0, s["cnt"], s["key"])]
                    for first, count, shard in subs:
                        rows.append((shard, s["key"], s["h"], s["cnt"], first, count, s["many"], part[first:first + count - 1 + length]))
                        size += count + length
                    if size >= PIECE:
                        yield out()
                        size = 0
        if rows:
            yield out()

    return texts.mapInArrow(released(run), OUT)


def repeated_starts(texts: list[bytes], starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text which of its first `starts` positions begin a string of `length` bytes that another start has too."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\xff".join(texts), np.uint8)  # no UTF-8 text has this byte
    begin = np.cumsum(lengths + 1) - lengths - 1
    is_start = np.zeros(len(data), bool)
    is_start[ragged(begin, starts)] = True
    sa = suffix_array(data)
    shared = common_prefixes(data, sa)[sa]
    group = np.cumsum(np.append(True, shared[1:] < length)) - 1
    number = np.bincount(group, is_start[sa])
    again = np.zeros(len(data), bool)
    again[sa] = number[group] >= 2
    again &= is_start
    return [again[b:b + n] for b, n in zip(begin.tolist(), starts.tolist(), strict=True)]


def sort_shards(rows: DataFrame, length: int) -> DataFrame:
    """(key, h, cnt, ranges): which windows of the segments occur elsewhere, as [from, to) pairs.

    Every shard holds all windows with its anchor, so its suffix array sees both sides of every match. Shards are
    sorted together up to about PIECE bytes of distinct text. Equal texts are sorted once.
    """
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "th")

    def solve(held: list[tuple]) -> pa.RecordBatch:
        """held: (text, starts, whether it occurs more than once, its segments)."""
        marks = repeated_starts([t for t, *_ in held], np.array([s for _, s, *_ in held]), length)
        keys, hs, cnts, ranges = [], [], [], []
        for (_, count, many, owners), mark in zip(held, marks, strict=True):
            if many:
                pairs = [(0, count)]
            else:
                own = np.concatenate([[False], mark, [False]])
                pairs = [tuple(p) for p in np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2).tolist()]
            for key, h, cnt, first in owners:
                keys.append(key)
                hs.append(h)
                cnts.append(cnt)
                ranges.append([x + first for p in pairs for x in p])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hs, pa.int64()), pa.array(cnts, pa.int64()),
                                           pa.array(ranges, pa.list_(pa.int32()))], names=["key", "h", "cnt", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, shard, th = 0, None, None
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("shard", "th", "key", "h", "cnt", "sub", "starts", "many")}
            raw = batch.column("bytes")
            for i in range(batch.num_rows):
                owner = (c["key"][i], c["h"][i], c["cnt"][i], c["sub"][i])
                if (c["shard"][i], c["th"][i]) == (shard, th):
                    text, count, _, owners = held[-1]
                    owners.append(owner)
                    held[-1] = (text, count, True, owners)
                    continue
                if c["shard"][i] != shard and size >= PIECE:
                    yield solve(held)
                    held, size = [], 0
                shard, th = c["shard"][i], c["th"][i]
                held.append((raw[i].as_py(), c["starts"][i], c["many"][i], [owner]))
                size += len(held[-1][0])
        if held:
            yield solve(held)

    return dealt.mapInArrow(released(run), "key bigint, h bigint, cnt bigint, ranges array<int>")


def removed(docs: DataFrame, length: int, as_text: bool) -> DataFrame:
    """docs (with _marks) plus n_bytes, n_removed, spans and kept."""

    def fill(batch: pa.RecordBatch) -> list[pa.Array]:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        marks = batch.column(batch.schema.get_field_index("_marks"))
        n_bytes, n_removed, spans, kept = [], [], [], []
        for i in range(batch.num_rows):
            raw, own = text[i].as_py() or b"", marks[i].as_py()
            pairs: list[list[int]] = []
            if own:
                edge = np.zeros(len(raw) + 1, np.int64)
                for m in own:
                    lo, cnt, ranges = m["pos"] >> 32, m["pos"] & 0xFFFFFFFF, m["ranges"]
                    for a, b in zip(ranges[::2], ranges[1::2], strict=True) if ranges is not None else [(0, cnt)]:
                        edge[lo + a] += 1
                        edge[lo + b - 1 + length] -= 1
                gone = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                pairs = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist()
            n_bytes.append(len(raw))
            n_removed.append(sum(b - a for a, b in pairs))
            spans.append([{"low": a, "high": b} for a, b in pairs])
            ends = [0, *(x for p in pairs for x in p), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
        return [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
                pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]

    kind = "string" if as_text else "binary"
    return with_arrow_columns(docs, f"n_bytes bigint, n_removed bigint, spans array<struct<low:bigint,high:bigint>>, kept {kind}", fill)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, spans (byte ranges, maximal) and kept (binary, or text without cut characters): every byte is removed that a string of `length`
    bytes covers which starts anywhere else too, in the same document or another. Matches never cross documents.

    1. Texts are cut into runs of windows at anchors, which depend on the text only. Runs whose anchor occurs once can't
       repeat and go. 2. Equal runs become one. Runs that share an anchor with different ones are sharded by it (the
       windows of a crowded anchor by further anchors), and a suffix array of each shard, by induced sorting, with its permuted
       common prefixes finds the windows that occur twice. 3. The marks return to the documents.
    Null counts as empty; texts shorter than `length` keep everything; repeated rows and copies lose everything that is long
    enough; keys may be null or repeated (a row is known by key and text); an empty table gives an empty one; columns named
    like the results are replaced, others pass through.
    """
    other = [c for c in docs.columns if c not in (key, text)]
    packed = docs.select(F.col(key).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_t"), F.coalesce(text, F.lit("")).alias("text"),
                         F.struct(*[F.col(c) for c in other], F.col(text).isNull().alias("_null")).alias("_rest"))
    found = segments(packed, length)
    # stored, so that both sides of the join are plain exchanges and a crowded key's rows can be split between tasks
    twice = checkpointed(found.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2").select("key"))
    live = checkpointed(found.join(twice, "key"))
    cnt = F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cnt")
    equal = live.groupBy("key", "h", cnt).agg(F.count("*").alias("n"), F.min(F.struct("_id", "_t", "pos")).alias("rep"))
    crowd = (equal.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.col("cnt") + length - 1).alias("size")).where("c >= 2")
             .select("key", (F.col("size") > HOT_BYTES).alias("hot")))
    wanted = equal.join(crowd, "key").select(
        "rep._id", "rep._t", F.struct("key", "h", "cnt", F.shiftright("rep.pos", 32).alias("lo"), (F.col("n") >= 2).alias("many"), "hot").alias("s"))
    lists = wanted.groupBy("_id", "_t").agg(F.collect_list("s").alias("_segs"))  # of one document
    match = F.col("l._id").eqNullSafe(F.col("d._id")) & (F.col("l._t") == F.col("d._t"))
    texts = packed.alias("d").join(lists.alias("l"), match).select("d._id", "d._t", "d.text", "d._rest", "l._segs")
    marks = (sort_shards(cut(texts, length), length).groupBy("key", "h", "cnt").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    # a run that was not sorted has an anchor of its own and occurs more than once: all its windows repeat
    back = live.withColumn("cnt", cnt).join(marks, ["key", "h", "cnt"], "left").where("ranges is null or size(ranges) > 0")
    per_text = back.groupBy("_id", "_t").agg(F.collect_list(F.struct("pos", "ranges")).alias("_marks"))
    joined = packed.alias("d").join(per_text.alias("l"), match, "left").select("d._id", "d._t", "d.text", "d._rest", "l._marks")
    done = removed(joined, length, as_text)
    made = ["n_bytes", "n_removed", "spans", "kept"]
    columns = []
    for c in docs.columns:
        if c in made:
            continue
        columns.append(F.col("_id").alias(c) if c == key else F.when(~F.col("_rest._null"), F.col("text")).alias(c) if c == text
                       else F.col(f"_rest.`{c}`").alias(c))
    return done.select(*columns, *made)
