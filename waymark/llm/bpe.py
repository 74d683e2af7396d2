"""Byte-level BPE encoding and decoding with recursive DuckDB queries, one database per task."""

from __future__ import annotations

import base64
import hashlib
import itertools
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from waymark.llm.common import ragged, range_hashes, slices, text_buffer, with_arrow_columns

WORDS_A_QUERY = 40_000
SQUARES_A_QUERY = 1_000_000  # sum of the squared lengths of a query's words: the rows that the recursion can make
PIECE = 48  # a word of over twice as many bytes is contracted in pieces of this size
SHIFTS = 4  # attempts to mend a border between pieces before the two become one
ROWS_A_QUERY = 250_000
TEXT_A_ROUND = 4 << 20
TEXT_A_SLICE = 512 << 10  # bytes that are split into words at a time: sums, hashes and masks take some fifty times as many
KEPT_WORDS = 250_000  # a task's memory of encoded words; results do not depend on it
LETTER, NUMBER, OTHER, SPACE = range(4)

#: Rows are (word w, position p, token t, next token u, next position n, id m of the merged pair (t, u), round k). Each
#: round contracts the leftmost pair of least id of every word; a word without a pair leaves the working table.
MERGE = """
WITH RECURSIVE s(w, p, t, u, n, m, k) AS (
  SELECT a.w, a.p, a.t, a.u, a.n, g.m, 0 FROM start a LEFT JOIN merges g ON g.l = a.t AND g.r = a.u
  UNION ALL
  SELECT x.w, x.p, x.t, x.u, x.n, g.m, x.k FROM (
    SELECT a.w, a.p, a.k + 1 AS k,
           CASE WHEN a.p = b.at THEN b.m ELSE a.t END AS t,
           CASE WHEN a.p = b.at THEN b.u ELSE CASE WHEN a.n = b.at THEN b.m ELSE a.u END END AS u,
           CASE WHEN a.p = b.at THEN b.n ELSE a.n END AS n
    FROM s a JOIN (
      SELECT h.w, (h.best & 4294967295)::INT AS at, (h.best >> 32)::INT AS m, h.gone, e.u, e.n
      FROM (SELECT w, min((m::BIGINT << 32) | p) AS best, arg_min(n, (m::BIGINT << 32) | p) AS gone
            FROM s WHERE m IS NOT NULL GROUP BY w) h
      JOIN s e ON e.w = h.w AND e.p = h.gone) b ON a.w = b.w AND a.p <> b.gone) x
  LEFT JOIN merges g ON g.l = x.t AND g.r = x.u)
SELECT s.w, s.t FROM s JOIN (SELECT w, max(k) AS k FROM s WHERE p = 0 GROUP BY w) z ON s.w = z.w AND s.k = z.k ORDER BY s.w, s.p
"""
#: A byte is the character of the same number here, so that bytes of part of a character can be joined as text.
#: One thread reads the sorted rows in order.
DECODE = """
SELECT d, string_agg(bytes, '') AS bytes
FROM (SELECT i.d, v.bytes FROM ids i JOIN vocabulary v ON v.id = i.t ORDER BY i.p) GROUP BY d ORDER BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point, as the splitting pattern has them."""
    table = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        points = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, points):
                table[low + m.start():low + m.end()] = kind
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = character_classes()
    kinds = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        width = np.where(data[lead] >= 0xF0, 4, np.where(data[lead] >= 0xE0, 3, 2))
        point = data[lead].astype(np.int64) & np.where(width == 4, 7, np.where(width == 3, 15, 31))
        for k in (1, 2, 3):
            more = width > k
            at = np.minimum(lead + k, len(data) - 1)
            point = np.where(more, (point << 6) | (data[at] & 63), point)
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            at = lead[width > k] + k
            inside = at < len(data)
            kinds[at[inside]] = kind[width > k][inside]
    return kinds


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of the splitting pattern begin, over texts that lie one after another.

    A match is a run of letters, numbers or others with one blank before it; white space keeps its last character apart when
    something follows it; an apostrophe that begins a match takes s, t, re, ve, m, ll or d with it.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    kinds = byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    fresh = first[:n].copy()
    fresh[1:] |= kinds[1:] != kinds[:-1]
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], n)
    kind = kinds[begin]
    starts = fresh.copy()
    starts = np.append(starts, False)
    blank = (kind == SPACE) & ~first[end]
    stop, last = end[blank], end[blank] - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    starts[last] = True
    starts[stop[data[last] == 0x20]] = False
    quote = (end - begin == 1) & (data[begin] == 0x27) & starts[begin] & ~first[end]
    after, limit = end[quote], end[np.minimum(np.flatnonzero(quote) + 1, len(end) - 1)]
    one = data[np.minimum(after, n - 1)]
    two = np.where(after + 1 < limit, data[np.minimum(after + 1, n - 1)], 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    taken = np.where(short, 1, np.where(long, 2, 0))
    after, limit, taken = after[taken > 0], limit[taken > 0], taken[taken > 0]
    starts[after] = False
    cut = after + taken
    starts[cut[cut < limit]] = True
    return np.flatnonzero(starts[:n])


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings data[start:end], and for every range the number of its string. Hashes only group the ranges:
    ranges of one hash are compared by their bytes, and where they differ all are told apart by their bytes alone."""
    raw = data.tobytes()
    _, where, inverse = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes, first = ends - starts, where[inverse]
    if np.array_equal(sizes, sizes[first]) and np.array_equal(data[ragged(starts, sizes)], data[ragged(starts[first], sizes)]):
        return [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], inverse
    numbers: dict[bytes, int] = {}
    inverse = np.fromiter((numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)),
                          np.int64, len(starts))
    return list(numbers), inverse


class Coder:
    """The vocabulary and merge table in a DuckDB of this process."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.alphabet = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(left, right, merged) for token, merged in ranks.items() for k in range(1, len(token))
                 if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None]
        table = np.array(pairs, np.int32).reshape(-1, 3)
        # without a folder for spilling: batches are bounded, and nothing may be left on an executor's disk
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._load("merges", {"l": table[:, 0], "r": table[:, 1], "m": table[:, 2]})
        self._load("vocabulary", {"id": np.array(list(ranks.values()), np.int32), "bytes": [t.decode("latin-1") for t in ranks]})
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.at, self.counts, self.uses, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def forget_rare(self) -> None:
        """Keep the words that came up in more than one slice, the most used ones up to half of KEPT_WORDS; their uses count half from now on."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > KEPT_WORDS // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[:KEPT_WORDS // 2]])
        mask = np.zeros(len(self.uses), bool)
        mask[kept] = True
        self.index = {w: i for i, w in enumerate(itertools.compress(self.index, mask.tolist()))}
        counts = self.counts[kept]
        self.flat = self.flat[ragged(self.at[kept], counts)]
        self.at, self.counts, self.uses = np.cumsum(counts) - counts, counts, (self.uses[kept] + 1) // 2

    def _load(self, name: str, columns: dict) -> None:
        given = pa.table({k: pa.array(v) for k, v in columns.items()})
        self.db.register("given", given)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by the recursive query; a word of the vocabulary is its own id."""
        made: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        todo = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is None:
                todo.append(i)
            else:
                made[i] = np.array([whole], np.int32)
        squares = np.cumsum([len(words[i]) ** 2 for i in todo])
        low = 0
        while low < len(todo):
            limit = (int(squares[low - 1]) if low else 0) + SQUARES_A_QUERY
            high = min(low + WORDS_A_QUERY, max(low + 1, int(np.searchsorted(squares, limit, "right"))))
            texts = [words[i] for i in todo[low:high]]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            data = self.alphabet[np.frombuffer(b"".join(texts), np.uint8)]
            w = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
            p = ragged(np.zeros(len(texts), np.int64), lengths).astype(np.int32)
            end = np.append(w[1:] != w[:-1], True)
            self._load("start", {"w": w, "p": p, "t": data, "u": np.where(end, -1, np.append(data[1:], -1)).astype(np.int32),
                                 "n": np.where(end, -1, p + 1).astype(np.int32)})
            done = self.db.sql(MERGE).to_arrow_table()
            ids, ends = done.column("t").to_numpy(), np.cumsum(np.bincount(done.column("w").to_numpy(), minlength=len(texts))).tolist()
            for i, a, b in zip(todo[low:high], [0, *ends[:-1]], ends, strict=True):
                made[i] = ids[a:b]
            low = high
        return made

    def spelt(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def contract_long(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of long words. Pieces are contracted apart; a row of tokens is the word's encoding if every two neighbours,
        contracted alone, stay as they are. Where two pieces do not fit so, their halves form a piece of their own; if that does
        not help in a few rounds, the two become one piece, so in the end the whole word would be."""
        pieces = [[w[i:i + PIECE] for i in range(0, len(w), PIECE)] for w in words]
        flat = iter(self.contract([p for some in pieces for p in some]))
        parts = [[next(flat) for _ in some] for some in pieces]
        fits: dict[tuple[int, int], bool] = {}
        rounds = 0
        while True:
            borders = {(int(x[-1]), int(y[0])) for some in parts for x, y in zip(some, some[1:], strict=False)} - fits.keys()
            asked = sorted(borders)
            alone = self.contract([self.tokens[x] + self.tokens[y] for x, y in asked])
            fits |= {pair: ids.tolist() == list(pair) for pair, ids in zip(asked, alone, strict=True)}
            torn: list[tuple[int, int, bytes]] = []
            for n, some in enumerate(parts):
                k = 0
                while k + 1 < len(some):
                    x, y = some[k], some[k + 1]
                    if fits[int(x[-1]), int(y[0])]:
                        k += 1
                        continue
                    left, right = (len(x) // 2, -(-len(y) // 2)) if rounds < SHIFTS else (0, len(y))
                    torn.append((n, k, self.spelt(x[left:]) + self.spelt(y[:right])))
                    some[k], some[k + 1] = x[:left], y[right:]
                    k += 2
            if not torn:
                return [np.concatenate(some) for some in parts]
            for (n, k, _), ids in zip(reversed(torn), reversed(self.contract([text for _, _, text in torn])), strict=True):
                parts[n].insert(k + 1, ids)
            parts = [[x for x in some if len(x)] for some in parts]
            rounds += 1

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        short = [i for i, w in enumerate(words) if len(w) <= 2 * PIECE]
        long = [i for i, w in enumerate(words) if len(w) > 2 * PIECE]
        made: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        for some, ids in ((short, self.contract([words[i] for i in short])), (long, self.contract_long([words[i] for i in long]))):
            for i, x in zip(some, ids, strict=True):
                made[i] = x
        return made

    def learn(self, words: list[bytes]) -> None:
        """Encode words that are not known and keep them for later batches."""
        made = self.encode_words(words)
        counts = np.fromiter(map(len, made), np.int64, len(made))
        at = np.cumsum(counts) - counts + len(self.flat)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.at, self.counts = np.concatenate([self.at, at]), np.concatenate([self.counts, counts])
        self.uses = np.concatenate([self.uses, np.zeros(len(made), np.int64)])
        self.flat = np.concatenate([self.flat, *made])

    def encode(self, column: pa.Array) -> pa.ListArray:
        data, offsets = text_buffer(column)
        ids, lengths = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for low, high in slices(offsets, TEXT_A_ROUND):
            part = data[offsets[low]:offsets[high]]
            bound = offsets[low:high + 1] - offsets[low]
            pieces, seen = [], {}
            for first, last in slices(bound, TEXT_A_SLICE):
                some = part[bound[first]:bound[last]]
                starts = pretokens(some, bound[first:last + 1] - bound[first])
                words, inverse = distinct_ranges(some, starts, np.append(starts[1:], len(some)))
                seen.update(dict.fromkeys(words))
                pieces.append((words, inverse, np.searchsorted(starts, bound[first:last + 1] - bound[first])))
            new = [w for w in seen if w not in self.index]
            if len(self.index) + len(new) > KEPT_WORDS:
                self.forget_rare()
                new = [w for w in seen if w not in self.index]
            if new:
                self.learn(new)
            for words, inverse, cut in pieces:
                known = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
                self.uses[known] += 1
                token = known[inverse]
                number = self.counts[token]
                ids.append(self.flat[ragged(self.at[token], number)])
                lengths.append(np.diff(np.append(0, np.cumsum(number))[cut]))
        ends = np.cumsum(np.concatenate(lengths))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids)))

    def decode(self, column: pa.Array) -> pa.Array:
        """The bytes of every list of ids. An id outside the vocabulary has none; a null list is empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        ends = np.cumsum(lengths)
        out: list[bytes] = [b""] * len(lengths)
        low = 0
        while low < len(lengths):
            before = int(ends[low] - lengths[low])
            high = max(low + 1, int(np.searchsorted(ends, before + ROWS_A_QUERY, "right")))
            d = np.repeat(np.arange(low, high, dtype=np.int32), lengths[low:high])
            self._load("ids", {"d": d, "p": np.arange(len(d), dtype=np.int32), "t": ids[before:before + len(d)]})
            done = self.db.sql(DECODE).to_arrow_table()
            for i, text in zip(done.column("d").to_pylist(), done.column("bytes").to_pylist(), strict=True):
                out[i] = text.encode("latin-1")
            low = high
        return pa.array(out, pa.binary())


_CODERS: dict[str, Coder] = {}


def forget() -> None:
    """Close the database of this process and drop its words; the next task makes its own."""
    for coder in _CODERS.values():
        coder.db.close()
        coder.forget()
    _CODERS.clear()


def _coder(name: str, sent: Broadcast) -> Coder:
    """The coder of the process. A function of the module, since a nested one is sent to the workers with a copy of the dictionary
    it uses, and what lies in such a copy `forget` does not reach."""
    if name not in _CODERS:
        forget()
        _CODERS[name] = Coder(sent.value)
    return _CODERS[name]


def _shared(df: DataFrame, ranks: dict[bytes, int]):
    """A function that gives the coder of the process it runs in. The vocabulary is broadcast."""
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    return lambda: _coder(name, sent)


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """docs with `ids` (array of int, without special tokens), as the tiktoken library encodes ordinary text.

    Every task splits its texts, merges its distinct words in DuckDB and gathers the ids; nothing is shuffled. The vocabulary
    (tens of thousands of tokens) is broadcast. Null and empty texts have no ids; other columns pass through, a column named
    ids is replaced; repeated rows stay; an empty table gives an empty one.
    """
    here = _shared(docs, ranks)
    return with_arrow_columns(docs, "ids array<int>", lambda batch: [here().encode(batch.column(text))], forget)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """encoded with `decoded` (binary): the tokens' bytes in order. Null and empty lists give no bytes."""
    here = _shared(encoded, ranks)
    return with_arrow_columns(encoded, "decoded binary", lambda batch: [here().decode(batch.column(ids))], forget)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """encode, then decode of those ids, in one visit to Python."""
    here = _shared(docs, ranks)

    def both(batch: pa.RecordBatch) -> list[pa.Array]:
        made = here().encode(batch.column(text))
        return [made, here().decode(made)]

    return with_arrow_columns(docs, "ids array<int>, decoded binary", both, forget)
