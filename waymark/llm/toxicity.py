"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Hasher, slices, text_buffer, with_arrow_columns, word_ranges

FIT_ROWS = 3000
PREFIXES = (4, 5, 6, 7)
SLOTS = 1 << 18
SEED_EVIDENCE = 12.0


@dataclass
class Model:
    """Weights of hashed word features for the tag `toxic` (the other tag has none), transition scores [from][to], and the
    logistic map from (number, maximum) of a document's marginals to its score."""

    weights: np.ndarray
    transitions: np.ndarray
    document: np.ndarray


def features(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(word, feature): 64-bit hashes of the word and of its beginnings of 4 to 7 bytes; a word shorter than a beginning
    repeats its own hash, so it adds nothing new."""
    hashed = Hasher(lower)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = hashed(starts, ends)
    for i, k in enumerate(PREFIXES, 1):
        long = ends - starts >= k
        out[:, i] = out[:, 0]
        out[long, i] = hashed(starts[long], starts[long] + k) ^ np.uint64(k)
    return out


def slots(hashes: np.ndarray) -> np.ndarray:
    """Weight slots; a feature that repeats the word's own hash goes to slot 0, whose weight stays zero."""
    out = (hashes % np.uint64(SLOTS - 1)).astype(np.int32) + 1
    out[:, 1:][hashes[:, 1:] == hashes[:, :1]] = 0
    return out


def word_scores(slot: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    score = np.full(len(slot), bias)
    for column in slot.T:
        score += weights[column]
    return score


def forward_backward(score: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios toxic : other of the forward and the backward messages of every word; sequences run from bounds[i] to bounds[i + 1].

    All sequences advance together, longest first, so a step works on the ones that still have words.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begin, longest = bounds[:-1][order], lengths[order]
    active = np.searchsorted(-longest, -np.arange(int(longest[0]) if len(longest) else 0), "left")
    ahead, back = np.empty(len(score)), np.zeros(len(score))
    t = transitions
    last = score[begin[:active[0]]] if len(active) else score[:0]
    if len(active):
        ahead[begin[:active[0]]] = last
    for step in range(1, len(active)):
        n = active[step]
        at = begin[:n] + step
        last = last[:n]
        last = score[at] + np.logaddexp(t[0, 1], last + t[1, 1]) - np.logaddexp(t[0, 0], last + t[1, 0])
        ahead[at] = last
    following = np.zeros(0)
    for step in range(len(active) - 2, -1, -1):
        n = active[step + 1]
        at = begin[:n] + step
        x = score[at + 1] + back[at + 1]
        following = np.logaddexp(t[1, 0], t[1, 1] + x) - np.logaddexp(t[0, 0], t[0, 1] + x)
        back[at] = following
    return ahead, back


def marginals(score: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    ahead, back = forward_backward(score, bounds, transitions)
    return 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))


def seeds(hashes: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that toxic documents have far more often than others.

    The evidence of a feature counts the different words before it, not documents, so that copies of a document add nothing.
    """
    doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    before = np.append(np.uint64(0), hashes[:-1, 0])
    before[bounds[:-1][bounds[:-1] < len(before)]] = 0
    found = []
    for k in range(hashes.shape[1]):
        real = slice(None) if k == 0 else hashes[:, k] != hashes[:, 0]
        pair = hashes[real, k] * np.uint64(0x9E3779B97F4A7C15) ^ before[real]
        _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
        clean = np.zeros(len(first), bool)
        clean[inverse[~toxic[doc[real]]]] = True
        names, of = np.unique(hashes[real, k][first], return_inverse=True)
        n = np.bincount(of, minlength=len(names))
        bad = np.bincount(of, ~clean, minlength=len(names))
        base = max(1e-6, (~clean).mean()) if len(clean) else 1.0
        share = bad / np.maximum(n, 1)
        found.append(names[(bad * np.log(np.maximum(share, 1e-9) / base) >= SEED_EVIDENCE) & (share >= 0.8)])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def fit(hashes: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, rounds: int = 25, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Maximum conditional likelihood of word tags: words of toxic documents that have a seed feature are toxic spans."""
    tag = np.isin(hashes, seeds(hashes, bounds, toxic)).any(1) & np.repeat(toxic, np.diff(bounds)) if len(hashes) else np.zeros(0, bool)
    slot = slots(hashes)
    weights, bias, transitions = np.zeros(SLOTS), -3.0, np.zeros((2, 2))
    memory, more, bias_memory = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    inner = np.ones(len(tag), bool)
    inner[bounds[1:][bounds[1:] > 0] - 1] = False
    pair = np.flatnonzero(inner)
    pair = pair[pair + 1 < len(tag)]
    total = max(1, int(tag.sum()))
    for _ in range(rounds if len(tag) else 0):
        score = word_scores(slot, weights, bias)
        ahead, back = forward_backward(score, bounds, transitions)
        miss = (tag - 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))) / total
        slope = sum(np.bincount(column, miss, SLOTS) for column in slot.T) - decay * weights
        slope[0] = 0
        x, r = score[pair + 1] + back[pair + 1], ahead[pair]
        expected = np.zeros(4)
        for part in range(0, len(pair), 1 << 16):
            some_x, some_r = x[part:part + (1 << 16)], r[part:part + (1 << 16)]
            log = np.stack([np.full(len(some_x), transitions[0, 0]), transitions[0, 1] + some_x, transitions[1, 0] + some_r,
                            transitions[1, 1] + some_r + some_x], 1)
            log = np.exp(log - log.max(1, keepdims=True))
            expected += (log / log.sum(1, keepdims=True)).sum(0)
        expected = expected.reshape(2, 2)
        seen = np.bincount(tag[pair].astype(int) * 2 + tag[pair + 1], minlength=4).reshape(2, 2)
        turn = (seen - expected) / total - decay * transitions
        memory, more = memory + slope * slope, more + turn * turn
        bias_memory += miss.sum() ** 2
        weights += rate * slope / np.sqrt(memory)
        transitions += rate * turn / np.sqrt(more)
        bias += rate * miss.sum() / np.sqrt(bias_memory)
    weights[0] = 0
    model = Model(np.append(weights, bias), transitions, np.zeros(3))
    model.document = fit_document(summary(hashes, bounds, model)[1], toxic)
    return model


def summary(hashes: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of every word; per document 1, expected number of toxic words on a log scale, greatest marginal)."""
    p = marginals(word_scores(slots(hashes), model.weights[:-1], model.weights[-1]), bounds, model.transitions)
    total = np.append(0, np.cumsum(p))
    sums = total[bounds[1:]] - total[bounds[:-1]]
    top = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        top[some] = np.maximum.reduceat(p, bounds[:-1][some])
    return p, np.stack([np.ones(len(top)), np.log1p(np.maximum(sums, 0)), top], 1)


def fit_document(x: np.ndarray, toxic: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - ridge * w)
        w += np.clip(step, -2, 2)
    return w


def read(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text after the last, features, word bounds, word starts and ends within the texts) of slices of texts."""
    data, offsets = text_buffer(column)
    for low, high in slices(offsets):
        own = offsets[low:high + 1] - offsets[low]
        lower, starts, ends = word_ranges(data[offsets[low]:offsets[high]], own)
        bounds = np.searchsorted(starts, own)
        base = np.repeat(own[:-1], np.diff(bounds))
        yield low, high, features(lower, starts, ends), bounds, starts - base, ends - base


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """A model from at most `rows` labelled documents (whole texts), picked by a hash of the key. Rows without a label, key
    or text don't count; of a key's labels the greatest holds; without any rows the model scores everything alike."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    chosen = marked.orderBy(F.xxhash64(key), key).limit(rows)
    sample = (docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(chosen), key)
              .dropDuplicates([key]).select(text, (F.col("_label") > 0).alias("_label")).toArrow())
    parts, lengths = [np.empty((0, 1 + len(PREFIXES)), np.uint64)], [np.zeros(1, np.int64)]
    for _, _, hashes, bounds, _, _ in read(sample.column(0)):
        parts.append(hashes)
        lengths.append(np.diff(bounds))
    toxic = sample.column(1).to_numpy().astype(bool)
    del sample
    hashes = np.concatenate(parts)
    parts.clear()
    return fit(hashes, np.cumsum(np.concatenate(lengths)), toxic)


def score(docs: DataFrame, model: Model, text: str = "text", at_least: float = 0.5) -> DataFrame:
    """docs with `score` (0 to 1) and `spans` (begin, end, probability of words whose marginal is at least `at_least`; byte
    offsets in the text). Null and empty texts have no words and the score of a document without any; columns named so are
    replaced, others pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fill(batch: pa.RecordBatch) -> list[pa.Array]:
        values, spans, counts = [], [], [np.zeros(0, np.int64)]
        for low, high, hashes, bounds, starts, ends in read(batch.column(text)):
            p, x = summary(hashes, bounds, sent.value)
            values.append(1 / (1 + np.exp(-np.clip(x @ sent.value.document, -30, 30))))
            hit = np.flatnonzero(p >= at_least)
            spans.append(np.stack([starts[hit], ends[hit], p[hit]], 1))
            counts.append(np.diff(np.searchsorted(hit, bounds)))
        every = np.concatenate(spans) if spans else np.empty((0, 3))
        inner = pa.StructArray.from_arrays([pa.array(every[:, 0].astype(np.int32)), pa.array(every[:, 1].astype(np.int32)), pa.array(every[:, 2])],
                                           names=["begin", "end", "probability"])
        bounds = np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32)
        return [pa.array(np.concatenate(values) if values else np.empty(0)), pa.ListArray.from_arrays(pa.array(bounds), inner)]

    return with_arrow_columns(docs, "score double, spans array<struct<begin:int,end:int,probability:double>>", fill)


def held_out(key: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its key as text, modulo 5, is 0."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0
