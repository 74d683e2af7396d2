"""Spelling variants: probe every word's edits against broadcast blocked Bloom filters, then join the hits with the vocabulary.

Words of one length have a shard of blocks of their own. An edit's hash follows from the word's in constant time, so an edit is
spelt out only when the filter holds it; the exact join with the vocabulary removes the false positives.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BASE, INVERSE, mix, released, shared_folder, slices, stored

BLOCK_WORDS = 8  # a block is 256 bits: eight words of 32, one bit of each for every member
PASS_BYTES = 128 << 20  # filter bytes that are broadcast at once; a larger filter takes several passes
PROBES_A_STEP = 1 << 21
HELD_WORDS, HELD_BYTES = 200_000, 32 << 20
#: Odd factors that choose the bit of each word of a block, as in split-block filters.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def counted_words(docs: DataFrame, key: str, text: str, letters: str, least: int, typo_every: int | None) -> DataFrame:
    """(word, n): lower-cased (A-Z only) runs of `letters` with at least `least` code points, partially counted in every task.

    With `typo_every`, a run loses the code point h % length if that number divides h, the crc32 of `<key>:<run>`.
    """
    pattern = re.compile(f"[{letters}]{{{least},}}")

    def flush(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        size = 0
        for batch in batches:
            for own, body in zip(batch.column(0), batch.column(1), strict=True):
                raw = body.as_py()
                if not raw:
                    continue
                counts: dict[str, int] = {}
                for word in pattern.findall(raw.lower().decode()):
                    counts[word] = counts.get(word, 0) + 1
                start = zlib.crc32((own.as_py() or "").encode() + b":")
                for word, n in counts.items():
                    if typo_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                    if word in held:
                        held[word] += n
                    else:
                        held[word] = n
                        size += len(word)
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    # binary lower-casing touches A-Z alone
    given = docs.select(F.col(key).cast("string").alias("own"), F.col(text).cast("string").cast("binary").alias("body"))
    return given.mapInArrow(released(run), "word string, n bigint")


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: str = "A-Za-zÀ-ÿ", least: int = 7,
               occurrences: int = 2, typo_every: int | None = None) -> DataFrame:
    """(word, n) of the words that occur at least `occurrences` times in all documents. Null texts have none; a null key is
    spelt as nothing; repeated rows count again."""
    counted = counted_words(docs, key, text, letters, least, typo_every).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= occurrences)


def values() -> np.ndarray:
    """A random number for every code point."""
    return np.random.default_rng(7).integers(0, 1 << 63, 0x110000, np.uint64) * np.uint64(2) + np.uint64(1)


_VALUES: list[np.ndarray] = []


def value_table() -> np.ndarray:
    if not _VALUES:
        _VALUES.append(values())
    return _VALUES[0]


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass(frozen=True)
class Layout:
    """Where each length's blocks lie: a shard of `blocks` blocks from block `first` on."""

    first: dict[int, int]
    blocks: dict[int, int]
    total: int

    @staticmethod
    def of(lengths: list[tuple[int, int]]) -> Layout:
        """From (length, number of words). A longer word has more edits, so its shard has more bits a word."""
        first, blocks, at = {}, {}, 0
        for length, n in sorted(lengths):
            bits = 16 + 2 * int(length).bit_length()
            first[length], blocks[length] = at, max(1, -(-n * bits // (32 * BLOCK_WORDS)))
            at += blocks[length]
        return Layout(first, blocks, at)

    def block(self, mixed: np.ndarray, length: int) -> np.ndarray:
        high = mixed >> np.uint64(32)
        return (high * np.uint64(self.blocks[length]) >> np.uint64(32)).astype(np.int64) + self.first[length]


def masks(mixed: np.ndarray, k: int) -> np.ndarray:
    """The bit of word k of the block."""
    low = mixed & np.uint64(0xFFFFFFFF)
    return np.uint64(1) << ((low * SALTS[k] & np.uint64(0xFFFFFFFF)) >> np.uint64(27))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, code points as a matrix) of the words of each length."""
    words = column.to_pylist()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, PROBES_A_STEP // max(1, length))
        for low in range(0, len(rows), step):
            some = rows[low:low + step]
            joined = "".join(words[i] for i in some.tolist()).encode("utf-32-le")
            yield length, some, np.frombuffer(joined, np.uint32).reshape(len(some), length)


def filter_blocks(words: DataFrame, layout: Layout) -> DataFrame:
    """(block, w0 ... w7): the filter's blocks that are not empty, united from all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, points in by_length(batch.column(0)):
                hashed = (value_table()[points] * powers(length)[:length]).sum(1, dtype=np.uint64)
                mixed = mix(hashed + np.uint64(length))
                columns = {"block": layout.block(mixed, length)}
                columns |= {f"w{k}": masks(mixed, k).astype(np.int64) for k in range(BLOCK_WORDS)}
                yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})

    names = [f"w{k}" for k in range(BLOCK_WORDS)]
    made = words.select("word").mapInArrow(released(run), "block bigint, " + ", ".join(f"{n} bigint" for n in names))
    return made.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])


def possible_neighbours(words: DataFrame, blocks: DataFrame, layout: Layout, alphabet: str) -> DataFrame:
    """(word, n, near): replacements by a greater letter and deletions that the filter holds. Every pair of words one edit apart
    is met from one side."""
    spark = words.sparkSession
    letters = np.array(sorted(map(ord, alphabet)), np.uint32)
    per_pass = max(1, PASS_BYTES // (4 * BLOCK_WORDS))
    out = None
    for low in range(0, max(1, layout.total), per_pass):
        high = min(layout.total, low + per_pass)
        given = blocks.where((F.col("block") >= low) & (F.col("block") < high)).toArrow()
        table = np.zeros((high - low, BLOCK_WORDS), np.uint32)
        at = given.column("block").to_numpy() - low
        for k in range(BLOCK_WORDS):
            table[at, k] = given.column(f"w{k}").to_numpy()
        sent = spark.sparkContext.broadcast(table)
        part = words.mapInArrow(lambda batches, sent=sent, low=low, high=high: _probe(batches, sent.value, low, high, layout, letters),
                                "word string, n bigint, near string")
        out = part if out is None else out.unionByName(part)
    return out


def _probe(batches: Iterator[pa.RecordBatch], table: np.ndarray, low: int, high: int, layout: Layout, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
    def held(hashed: np.ndarray, length: int) -> np.ndarray:
        """Places of the hashes that the filter holds."""
        mixed = mix(hashed.ravel() + np.uint64(length))
        block = layout.block(mixed, length) - low
        left = np.arange(len(mixed)) if high - low == layout.total else np.flatnonzero((block >= 0) & (block < high - low))
        for k in range(BLOCK_WORDS):
            left = left[(table[block[left], k] & masks(mixed[left], k).astype(np.uint32)) != 0]
        return left

    def spelt(batch: pa.RecordBatch, rows: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        near = [p.tobytes().decode("utf-32-le") for p in points]
        chosen = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), pa.array(near, pa.string())], names=["word", "n", "near"])

    for batch in batches:
        for length, rows, points in by_length(batch.column(0)):
            power, value = powers(length), value_table()
            terms = value[points] * power[:length]
            sums = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
            if length in layout.blocks:
                # positions and words in steps, so that one step has a bounded number of edits
                for begin, stop in slices(np.arange(length + 1, dtype=np.int64) * len(rows) * len(letters), PROBES_A_STEP):
                    for first, last in slices(np.arange(len(rows) + 1, dtype=np.int64) * (stop - begin) * len(letters), PROBES_A_STEP):
                        here = points[first:last, begin:stop]
                        change = (value[letters][None, None, :] - value[here][:, :, None]) * power[begin:stop][None, :, None]
                        w, p, x = np.nonzero(letters[None, None, :] > here[:, :, None])
                        hit = held(sums[first + w, length] + change[w, p, x], length)
                        if len(hit):
                            made = points[first + w[hit]].copy()
                            made[np.arange(len(hit)), begin + p[hit]] = letters[x[hit]]
                            yield spelt(batch, rows[first + w[hit]], made)
            if length - 1 in layout.blocks:
                # of equal letters side by side only the first is deleted: the word is the same
                w, p = np.nonzero(np.concatenate([np.ones((len(rows), 1), bool), points[:, 1:] != points[:, :-1]], 1))
                hit = held(sums[w, p] + (sums[w, length] - sums[w, p + 1]) * INVERSE, length - 1)
                for low_hit in range(0, len(hit), max(1, PROBES_A_STEP // length)):
                    some = hit[low_hit:low_hit + max(1, PROBES_A_STEP // length)]
                    keep = np.ones((len(some), length), bool)
                    keep[np.arange(len(some)), p[some]] = False
                    yield spelt(batch, rows[w[some]], points[w[some]][keep].reshape(len(some), length - 1))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words one inserted, deleted or replaced code point apart, in both directions.
    `words` is a stored table."""
    lengths = [(r["length"], r["n"]) for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()]
    layout = Layout.of(lengths)
    if not layout.total:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    alphabet = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    hits = possible_neighbours(words, filter_blocks(words, layout), layout, "".join(r["c"] for r in alphabet))
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    one = hits.join(known, "near").select("word", "n", "near", "near_n")
    other = one.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return one.unionByName(other)


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: str = "A-Za-zÀ-ÿ", least: int = 7,
             occurrences: int = 2, factor: int = 10, typo_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is its near word of greatest n (ties: the first in code-point order), if that is at least `factor` times the
    word's own; null otherwise. The root follows the forms to the last. n grows by `factor` with every form, so the chains are
    short; they are followed by pointer doubling. An empty table and one without such words give no rows; other columns are
    not read.
    """
    folder = shared_folder(docs.sparkSession)

    words = stored(vocabulary(docs, key, text, letters, least, occurrences, typo_every), f"{folder}/words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    fits = -F.col("best.minus") >= factor * F.col("n")
    chosen = stored(near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")),
                    f"{folder}/near")
    hops = chosen.where("form is not null").select("word", F.col("form").alias("root"))
    for step in range(64):
        next_hop = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(hops.join(next_hop, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                  F.col("further").isNotNull().alias("moved")), f"{folder}/roots{step}")
        hops = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return (words.join(chosen, "word", "left").join(hops, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                    F.col("form_n").cast("bigint").alias("form_n")))
