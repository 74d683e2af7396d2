"""Benchmark decontamination with a positional inverted index of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import range_hashes, released, slices, text_buffer, word_ranges
from waymark.session import checkpointed

BLOCK_BYTES = 2 << 20
ITEM_WORDS = 1_000_000  # words of items that are sent to the index blocks at a time


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and at the end)."""
    lower, starts, ends = word_ranges(data, offsets)
    return range_hashes(lower, starts, ends), np.searchsorted(starts, offsets)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, docs, bounds, terms, starts, postings): one row per block of documents, the whole token stream inverted.

    A term is the 64-bit hash of a word. Its postings are its positions in the block's stream of words, ascending; `bounds`
    says which positions belong to which document. A block holds about 2 MB of text, so rows stay small; a longer text is a
    block of its own. Nothing is shuffled: a phrase lies in one document, so in one block. `block` numbers the blocks; with its
    place in the block it tells documents apart whose keys are equal or null, so store the index before it is searched.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            data, offsets = text_buffer(batch.column(1))
            for low, high in slices(offsets, BLOCK_BYTES):
                stream, bounds = words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                order = np.argsort(stream, kind="stable")
                ranked = stream[order]
                starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys.slice(low, high - low).to_pylist()], pa.list_(keys.type)), pa.array([bounds.astype("<u4").tobytes()], pa.binary()),
                     pa.array([ranked[starts].astype("<u8").tobytes()], pa.binary()),
                     pa.array([np.append(starts, len(ranked)).astype("<u4").tobytes()], pa.binary()),
                     pa.array([order.astype("<u4").tobytes()], pa.binary())], names=["docs", "bounds", "terms", "starts", "postings"])

    made = docs.select(key, text).mapInArrow(released(run), f"docs array<{kind}>, bounds binary, terms binary, starts binary, postings binary")
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


class Block:
    """One row of the index."""

    def __init__(self, row: dict):
        self.docs, self.bounds = row["docs"], np.frombuffer(row["bounds"], "<u4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.starts, self.postings = np.frombuffer(row["starts"], "<u4"), np.frombuffer(row["postings"], "<u4")

    def list_of(self, term: int) -> np.ndarray:
        i = int(np.searchsorted(self.terms, np.uint64(term)))
        if i == len(self.terms) or int(self.terms[i]) != term:
            return self.postings[:0]
        return self.postings[self.starts[i]:self.starts[i + 1]]

    def phrase(self, terms: list[int], rarest_first: list[int], slop: int) -> np.ndarray:
        """Where in the stream the phrase begins. With slop, every term but the rarest may be off its place by so many words."""
        lead = rarest_first[0]
        begin = self.list_of(terms[lead]).astype(np.int64) - lead
        doc = np.searchsorted(self.bounds, begin + lead, "right")
        inside = (begin >= self.bounds[np.maximum(doc - 1, 0)]) & (begin + len(terms) <= self.bounds[np.minimum(doc, len(self.bounds) - 1)])
        if slop:
            inside[:] = True
        begin, doc = begin[inside], doc[inside]
        for k in rarest_first[1:]:
            if not len(begin):
                break
            places = self.list_of(terms[k])
            if not len(places):
                return begin[:0]
            low, high = begin + k - slop, begin + k + slop
            if slop:
                low, high = np.maximum(low, self.bounds[doc - 1]), np.minimum(high, self.bounds[doc] - 1)
            at = np.searchsorted(places, low)
            ok = (at < len(places)) & (places[np.minimum(at, len(places) - 1)] <= high)
            begin, doc = begin[ok], doc[ok]
        return begin


@dataclass(frozen=True)
class Phrases:
    """Windows of items: terms of window w are flat[starts[w]:starts[w + 1]]; items[w] is its item."""

    flat: np.ndarray
    starts: np.ndarray
    items: list
    rarity: dict[int, int]

    def __iter__(self):
        for w in range(len(self.starts) - 1):
            yield w, self.flat[self.starts[w]:self.starts[w + 1]].tolist()


def windows(texts: list[tuple[object, str]], length: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(terms one after another, where each window begins, its item). An item with fewer words, but not none, is one window."""
    column = pa.array([t for _, t in texts], pa.string())
    stream, bounds = words(*text_buffer(column))
    flat, starts, items = [], [0], []
    for (item, _), low, high in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for at in range(low, max(low + 1, high - length + 1) if high > low else low):
            flat.append(stream[at:min(at + length, high)])
            starts.append(starts[-1] + len(flat[-1]))
            items.append(item)
    return np.concatenate(flat) if flat else np.empty(0, np.uint64), np.array(starts), items


def term_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each of the (bounded) test terms occurs in the whole index."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<u4").astype(np.int64)
                at = np.searchsorted(own, sent.value)
                hit = (at < len(own)) & (own[np.minimum(at, max(0, len(own) - 1))] == sent.value) if len(own) else np.zeros(len(at), bool)
                total[hit] += np.diff(starts)[at[hit]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(some), "n": pa.array(total[some])})

    found = index.select("terms", "starts").mapInArrow(released(run), "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {int(terms[r["i"]]): r["n"] for r in found}


def matches(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", length: int = 10, slop: int = 0) -> DataFrame:
    """(doc, n_words, n_hit, items, spans): one row per indexed document, with what occurs in it.

    items: the sorted ids of items of which a window of `length` words occurs. spans: (first word, word after the last) of the
    hit words, merged; their sum is n_hit. slop = 0 asks for exact phrases; with more, every word but the window's rarest may be off
    its place by that many words, within the document (a proximity match, whose window counts as hit). For every window the
    postings of its rarest term, in the whole corpus, are the candidates; the others, offset-adjusted, thin them out. Items
    are sent to the blocks in groups of at most ITEM_WORDS words. Items with null or no words have no windows.
    """
    kind = dict(index.dtypes)["docs"][len("array<"):-1]
    item_kind = dict(items.dtypes)[item]
    parts: list[DataFrame] = []
    group: list[tuple[object, str]] = []
    size = 0

    def search(texts: list[tuple[object, str]]) -> DataFrame:
        flat, starts, ids = windows(texts, length)
        counts = term_counts(index, np.unique(flat))
        phrases = Phrases(flat, starts, ids, counts)
        plans = []
        for w, terms in phrases:
            rarity = [counts.get(t, 0) for t in terms]
            if min(rarity):
                plans.append((ids[w], terms, sorted(range(len(terms)), key=rarity.__getitem__)))
        sent = index.sparkSession.sparkContext.broadcast(plans)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row)
                    n = int(block.bounds[-1])
                    edge = np.zeros(n + 1, np.int64)
                    of_doc: dict[int, set] = {}
                    for one, terms, order in sent.value:
                        begin = block.phrase(terms, order, slop)
                        if len(begin):
                            lead = begin + order[0]
                            doc = np.searchsorted(block.bounds, lead, "right") - 1
                            np.add.at(edge, np.maximum(begin, block.bounds[doc]), 1)
                            np.add.at(edge, np.minimum(begin + len(terms), block.bounds[doc + 1]), -1)
                            for d in np.unique(doc).tolist():
                                of_doc.setdefault(d, set()).add(one)
                    hit = np.cumsum(edge)[:n] > 0
                    number = np.diff(np.append(0, np.cumsum(hit))[block.bounds])
                    spans = []
                    for d in range(len(block.docs)):
                        if not number[d]:
                            spans.append([])
                            continue
                        own = np.concatenate([[False], hit[block.bounds[d]:block.bounds[d + 1]], [False]])
                        change = np.flatnonzero(own[1:] != own[:-1])
                        spans.append([{"low": a, "high": b} for a, b in change.reshape(-1, 2).tolist()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(block.docs), row["block"])), pa.array(np.arange(len(block.docs))),
                         pa.array(block.docs, batch.schema.field("docs").type.value_type), pa.array(np.diff(block.bounds)), pa.array(number),
                         pa.array([sorted(of_doc.get(d, ())) for d in range(len(block.docs))], pa.list_(pa.string() if item_kind == "string" else pa.int64())),
                         pa.array(spans, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))],
                        names=["block", "place", "doc", "n_words", "n_hit", "items", "spans"])

        made = "string" if item_kind == "string" else "bigint"
        return index.mapInArrow(released(run), f"block bigint, place bigint, doc {kind}, n_words bigint, n_hit bigint, items array<{made}>, spans array<struct<low:bigint,high:bigint>>")

    for r in items.select(item, text).where(F.col(text).isNotNull()).toLocalIterator():
        group.append((r[0], r[1]))
        size += len(r[1]) // 2 + 1
        if size >= ITEM_WORDS:
            parts.append(search(group))
            group, size = [], 0
    parts.append(search(group))
    if len(parts) == 1:
        return parts[0].drop("block", "place")
    return merged(parts)


def merged(parts: list[DataFrame]) -> DataFrame:
    """Results of several groups of items as one: spans are united per document, by its block and place."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    together = every.groupBy("block", "place").agg(
        F.first("doc").alias("doc"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_all"))
    united = F.expr("""aggregate(_all, cast(array() as array<struct<low:bigint,high:bigint>>), (acc, s) ->
        CASE WHEN size(acc) > 0 AND element_at(acc, -1).high >= s.low
             THEN concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).low AS low, greatest(element_at(acc, -1).high, s.high) AS high)))
             ELSE concat(acc, array(s)) END)""")
    together = together.withColumn("spans", united)
    return together.select("doc", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.high - s.low)").alias("n_hit"), "items", "spans")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", length: int = 10, slop: int = 0) -> DataFrame:
    """(key, n_words, n_hit, items, spans) for every document, by an index that is built and stored in the checkpoint folder.

    Null and empty texts have no words; repeated rows keep a row each; empty tables give empty results or no hits; other
    columns are not read.
    """
    index = checkpointed(build_index(docs, key, text))
    return matches(index, items, length=length, slop=slop).withColumnRenamed("doc", key)
