"""Cross-tokenizer alignment: token groups of two tokenizers, and how many documents hold each linked pair of ids.

Pair-document records are dealt by radix of the A id into zstd runs, which a table in the shared folder keeps. A k-way heap
merge of the runs' pair lists counts each pair in A-major order, so an A id's highest count is known when its last pair is;
the counts then stream past the runs' records, and the contributions go back to the documents.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.llm.common import ragged, released, shared_folder, slices, stored

RADIX_BITS = 6  # 64 radices; a radix's distinct pairs are held by the task that merges it
ID_BITS, DOC_BITS = 24, 16  # a record is one 64-bit number: A id, B id, document of the run
RECORDS_A_RUN = 4_000_000
LINKS_A_STEP = 4_000_000
TEXT_A_STEP = 1 << 20
BLOCK = 1 << 16  # pairs of one zstd frame
FAN_IN = 64
RUNS_A_TASK = 16  # runs whose records of one radix meet in one task
#: Fixed value: how a byte-level pre-tokenizer splits texts.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOW = np.uint64((1 << ID_BITS) - 1)


@dataclass(frozen=True)
class Tokenizers:
    """The two vocabularies as files' contents: byte-level BPE (JSON, side A) and pieces with byte fallback (model, side B)."""

    a: bytes
    b: bytes

    @staticmethod
    def read(a_path: str, b_path: str) -> Tokenizers:
        with open(a_path, "rb") as a, open(b_path, "rb") as b:
            return Tokenizers(a.read(), b.read())


def byte_level_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked_encoding(file: dict, alphabet: dict[str, int]):
    """The vocabulary of a tokenizer file as an encoding of the tiktoken library, which gives the same ids several times faster, if
    ids rise in the order of the merges and nothing but the byte-level pattern splits texts; else None."""
    import tiktoken

    model, merges = file["model"], [m.split(" ") if isinstance(m, str) else m for m in file["model"].get("merges", ())]
    split = file.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and file.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex")
             and not split.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
             and not model.get("ignore_merges"))
    special = {t["id"] for t in file.get("added_tokens", ())}
    ids = {token: i for token, i in model["vocab"].items() if i not in special}
    made = [ids.get("".join(m), -1) for m in merges]
    if not plain or len(ids) != 256 + len(made) or made != sorted(set(made)) or any(c not in alphabet for t in ids for c in t):
        return None
    if made and (made[0] < 256 or max(ids[c] for c in alphabet if c in ids) >= made[0]):
        return None
    ranks = {bytes(alphabet[c] for c in token): i for token, i in ids.items()}
    return tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoders:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, given: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        first = Tokenizer.from_str(given.a.decode())
        first.encode_special_tokens = True
        first.no_truncation()
        first.no_padding()
        self.second = sentencepiece.SentencePieceProcessor(model_proto=given.b)
        alphabet = byte_level_alphabet()
        count = max(first.get_vocab(True).values()) + 1
        self.a_bytes = [b""] * count
        for token, i in first.get_vocab(True).items():
            known = all(c in alphabet for c in token)
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        ranked = ranked_encoding(json.loads(given.a), alphabet)
        self.encode_first = ranked.encode_ordinary if ranked else lambda text: first.encode(text, add_special_tokens=False).ids
        self.b_bytes = [self._piece(i) for i in range(self.second.get_piece_size())]
        self.a_len, self.b_len = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        # every id with each of the marks that may follow it
        self.texts = [f"{i}{mark}".encode() for i in range(max(count, len(self.b_bytes))) for mark in ",|;"]

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.encode_first(" " + t) for t in texts], self.second.encode(texts, num_threads=1)

    def spells(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = b" " + text.encode()
        return (b"".join(map(self.a_bytes.__getitem__, a)) == whole) and (b"".join(map(self.b_bytes.__getitem__, b)) == whole)


_ENCODERS: dict[str, Encoders] = {}


def _shared(df: DataFrame, given: Tokenizers) -> Callable[[], Encoders]:
    """A function that gives the encoders of the process it runs in. The vocabulary files (2 MB) are broadcast."""
    name = hashlib.sha256(given.a + given.b).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(given)

    def here() -> Encoders:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoders(sent.value)
        return _ENCODERS[name]

    return here


@dataclass
class Groups:
    """The tokens of several texts, cut where tokens of both sides end. Group g has A tokens a_at[g]:a_at[g + 1], B alike."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    text_at: np.ndarray  # groups text_at[t]:text_at[t + 1] are those of text t

    def __len__(self) -> int:
        return len(self.a_at) - 1


def cut(encoders: Encoders, first: list[list[int]], second: list[list[int]]) -> Groups:
    """Groups of texts whose tokens spell the same bytes on both sides."""
    a = np.fromiter((i for ids in first for i in ids), np.int64, sum(map(len, first)))
    b = np.fromiter((i for ids in second for i in ids), np.int64, sum(map(len, second)))
    a_end, b_end = np.cumsum(encoders.a_len[a]), np.cumsum(encoders.b_len[b])
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    a_at = np.append(0, np.searchsorted(a_end, common, "right"))
    b_at = np.append(0, np.searchsorted(b_end, common, "right"))
    last = np.cumsum([len(ids) for ids in first])
    return Groups(a, b, a_at, b_at, np.append(0, np.searchsorted(a_at, last)))


def described(encoders: Encoders, groups: Groups) -> Iterator[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text."""
    a_of = np.repeat(np.arange(len(groups)), np.diff(groups.a_at))
    b_of = np.repeat(np.arange(len(groups)), np.diff(groups.b_at))
    codes = np.empty(len(groups.a) + len(groups.b), np.int64)
    a_mark, b_mark = np.zeros(len(groups.a), np.int64), np.zeros(len(groups.b), np.int64)
    a_mark[groups.a_at[1:] - 1] = 1
    b_mark[groups.b_at[1:] - 1] = 2
    codes[np.arange(len(groups.a)) + groups.b_at[a_of]] = groups.a * 3 + a_mark
    codes[np.arange(len(groups.b)) + groups.a_at[b_of + 1]] = groups.b * 3 + b_mark
    at = (groups.a_at + groups.b_at)[groups.text_at]
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield b"".join(map(encoders.texts.__getitem__, codes[low:high].tolist()))[:-1]


def by_radix(ids: np.ndarray) -> np.ndarray:
    """A ids with their radix, the lowest bits, in front: ids of one radix are one range and ascend inside it."""
    ids = ids.astype(np.uint64)
    return (ids & np.uint64((1 << RADIX_BITS) - 1)) << np.uint64(ID_BITS - RADIX_BITS) | ids >> np.uint64(RADIX_BITS)


def original(ids: np.ndarray) -> np.ndarray:
    shift = np.uint64(ID_BITS - RADIX_BITS)
    return (ids & ((np.uint64(1) << shift) - np.uint64(1))) << np.uint64(RADIX_BITS) | ids >> shift


def linked(groups: Groups, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records, links of each): the distinct pairs of every document; `documents` numbers the texts."""
    side = by_radix(groups.a) << np.uint64(ID_BITS + DOC_BITS)
    a_of = np.repeat(np.arange(len(groups)), np.diff(groups.a_at))
    number = np.repeat(documents.astype(np.uint64), np.diff(groups.text_at))
    b = groups.b.astype(np.uint64) << np.uint64(DOC_BITS)
    partners = np.diff(groups.b_at)[a_of]
    ends = np.cumsum(partners)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    while low < len(partners):
        # a group of very many tokens is met in steps; every step leaves its distinct pairs only
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + LINKS_A_STEP, "right")))
        of = a_of[low:high]
        times = partners[low:high]
        pairs = np.repeat(side[low:high] | number[of], times) | b[ragged(groups.b_at[of], times)]
        kept.append(np.unique(pairs, return_counts=True))
        if len(kept) > 8:
            kept = [summed(kept)]
        low = high
    return summed(kept)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of all parts with their values added."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    values = np.concatenate([v for _, v in parts])
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    if not len(keys):
        return keys, values
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


def pack(values: np.ndarray) -> bytes:
    """Frames of BLOCK numbers, each in the fewest bytes a number needs, compressed."""
    coder, out = zstandard.ZstdCompressor(level=3), []
    for low in range(0, len(values), BLOCK):
        part = values[low:low + BLOCK]
        width = next(w for w in (1, 2, 4, 8) if w == 8 or int(part.max()) < 1 << 8 * w)
        frame = coder.compress(bytes([width]) + part.astype(f"<u{width}").tobytes())
        out.append(len(frame).to_bytes(4, "little") + frame)
    return b"".join(out)


def frames(blob: bytes) -> Iterator[np.ndarray]:
    decoder, at = zstandard.ZstdDecompressor(), 0
    while at < len(blob):
        size = int.from_bytes(blob[at:at + 4], "little")
        raw = decoder.decompress(blob[at + 4:at + 4 + size])
        yield np.frombuffer(raw, f"<u{raw[0]}", offset=1)
        at += 4 + size


def unpack(blob: bytes, kind: type = np.int64) -> np.ndarray:
    parts = list(frames(blob))
    return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)


def pack_ascending(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def ascending(blob: bytes) -> Iterator[np.ndarray]:
    last = np.uint64(0)
    for part in frames(blob):
        keys = np.cumsum(part.astype(np.uint64), dtype=np.uint64) + last
        last = keys[-1]
        yield keys


class RunWriter:
    """Collects the records of one task and hands them out as runs."""

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        self.run = uuid.uuid4().int & ((1 << 63) - 1)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.records = self.documents = 0

    def full(self, more: int) -> bool:
        return self.documents + more > 1 << DOC_BITS or self.records >= RECORDS_A_RUN

    def add(self, records: np.ndarray, links: np.ndarray) -> None:
        self.parts.append((records, links))
        self.records += len(records)

    def rows(self) -> Iterator[dict]:
        """One row for each radix that has records: the pairs, the documents of each, their numbers and links."""
        if self.records:
            keys, links = summed(self.parts)
            pairs, numbers = keys >> np.uint64(DOC_BITS), (keys & np.uint64((1 << DOC_BITS) - 1)).astype(np.uint16)
            shift = np.uint64(2 * ID_BITS - RADIX_BITS)
            edges = np.searchsorted(pairs >> shift, np.arange((1 << RADIX_BITS) + 1, dtype=np.uint64))
            for radix in range(1 << RADIX_BITS):
                low, high = int(edges[radix]), int(edges[radix + 1])
                if low == high:
                    continue
                some = pairs[low:high]
                first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
                step = np.diff(numbers[low:high], prepend=np.uint16(0))
                yield {"run": self.run, "radix": radix, "pairs": pack_ascending(some[first]),
                       "holders": pack(np.diff(np.append(first, len(some)))), "numbers": pack(step), "links": pack(links[low:high])}
        self.start()


STORED = ("run bigint, radix int, pairs binary, holders binary, numbers binary, links binary, "
          "no int, key {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string")


def encoded_runs(docs: DataFrame, key: str, text: str, given: Tokenizers, keep_groups: bool) -> DataFrame:
    """Rows of two kinds: a run's records of one radix, and (radix null) its documents."""
    here = _shared(docs, given)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = STORED.format(key=source.schema["key"].dataType.simpleString())
    empty = docs.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(empty.schema)

    def as_batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in arrow}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = RunWriter()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            column = batch.column(1).cast(pa.large_string())
            sizes = compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            for low, high in slices(np.append(0, np.cumsum(sizes)), TEXT_A_STEP):
                for begin in range(low, high, 1 << DOC_BITS):
                    stop = min(high, begin + (1 << DOC_BITS))
                    if writer.full(stop - begin):
                        for row in writer.rows():
                            yield as_batch([row])
                    yield as_batch(list(_documents(here(), writer, keys[begin:stop], column.slice(begin, stop - begin).to_pylist(), keep_groups)))
        for row in writer.rows():
            yield as_batch([row])

    return source.mapInArrow(released(run), schema)


def _documents(encoders: Encoders, writer: RunWriter, keys: list, texts: list[str | None], keep_groups: bool) -> Iterator[dict]:
    """The rows of some documents; their records go to the writer. Copies among them are encoded once."""
    distinct = list(dict.fromkeys(t for t in texts if t))
    first, second = encoders.encode(distinct) if distinct else ([], [])
    good = [i for i, t in enumerate(distinct) if encoders.spells(t, first[i], second[i])]
    place = {distinct[i]: at for at, i in enumerate(good)}
    if good:
        groups = cut(encoders, [first[i] for i in good], [second[i] for i in good])
        names = list(described(encoders, groups))
        a_text, b_text = np.diff(groups.a_at[groups.text_at]), np.diff(groups.b_at[groups.text_at])
        links = np.append(0, np.cumsum(np.diff(groups.a_at) * np.diff(groups.b_at)))[groups.text_at]
        records, times = linked(groups, np.arange(len(good)))
        of = (records & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
        uses: list[list[int]] = [[] for _ in good]
    for no, (key, text) in enumerate(zip(keys, texts, strict=True), writer.documents):
        at = place.get(text)
        row = {"run": writer.run, "no": no, "key": key, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "groups": None}
        if at is not None:
            uses[at].append(no)
            row |= {"n_a": int(a_text[at]), "n_b": int(b_text[at]), "n_groups": int(groups.text_at[at + 1] - groups.text_at[at]),
                    "n_links": int(links[at + 1] - links[at]), "groups_sha256": hashlib.sha256(names[at]).hexdigest(),
                    "groups": names[at].decode() if keep_groups else None}
        yield row
    if good:
        # a record for every document of its text
        times_used = np.fromiter(map(len, uses), np.int64, len(uses))
        flat = np.fromiter((no for u in uses for no in u), np.uint64, int(times_used.sum()))
        own = np.repeat(np.arange(len(of)), times_used[of])
        number = flat[ragged((np.cumsum(times_used) - times_used)[of], times_used[of])]
        writer.add((records ^ of.astype(np.uint64))[own] | number, times[own])
    writer.documents += len(texts)


def merge(runs: list[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge of (ascending pairs, counts): blocks of pairs and their summed counts, ascending.

    The heap holds the last pair of every run's current frame. Everything up to the least of them is complete.
    """
    sources = [zip(ascending(pairs), frames(counts), strict=True) for pairs, counts in runs]
    current: list[tuple[np.ndarray, np.ndarray] | None] = [next(s, None) for s in sources]
    heap = [(int(part[0][-1]), i) for i, part in enumerate(current) if part is not None]
    heapq.heapify(heap)
    while heap:
        last = heap[0][0]
        taken = []
        for i, part in enumerate(current):
            if part is None:
                continue
            end = int(np.searchsorted(part[0], np.uint64(last), "right"))
            if end:
                taken.append((part[0][:end], part[1][:end].astype(np.int64)))
                current[i] = (part[0][end:], part[1][end:])
        yield summed(taken)
        while heap and heap[0][0] == last:
            i = heap[0][1]
            current[i] = next(sources[i], None)
            if current[i] is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (int(current[i][0][-1]), i))


def merged_run(runs: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    parts = list(merge(runs))
    return pack_ascending(np.concatenate([k for k, _ in parts])), pack(np.concatenate([v for _, v in parts]))


class Levels:
    """Runs of one radix: FAN_IN runs of a level become one of the next, so few are open at a time."""

    def __init__(self) -> None:
        self.levels: list[list[tuple[bytes, bytes]]] = [[]]

    def add(self, run: tuple[bytes, bytes], level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN_IN:
            full, self.levels[level] = self.levels[level], []
            self.add(merged_run(full), level + 1)

    def counted(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of whole A ids: (pairs, counts, whether a count is its A id's highest)."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for pairs, counts in merge([run for level in self.levels for run in level]):
            a = pairs >> np.uint64(ID_BITS)
            cut_at = int(np.searchsorted(a, a[-1]))
            if cut_at:
                yield self._with_highest([*held, (pairs[:cut_at], counts[:cut_at])])
                held = []
            elif held and held[-1][0][-1] >> np.uint64(ID_BITS) != a[0]:
                yield self._with_highest(held)
                held = []
            held.append((pairs[cut_at:], counts[cut_at:]))
        if held:
            yield self._with_highest(held)

    @staticmethod
    def _with_highest(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, counts = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
        a = pairs >> np.uint64(ID_BITS)
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(a))))
        return pairs, counts, counts == highest


def count_pairs(runs: DataFrame) -> DataFrame:
    """(radix, pairs, counts, best): all pairs with the number of documents that hold them, in blocks of whole A ids.

    Only the pair lists travel, each pair once a run whatever the number of its documents.
    """
    dealt = runs.select("radix", "pairs", "holders").repartition("radix").sortWithinPartitions("radix")
    kinds = {"radix": pa.int32(), "pairs": pa.binary(), "counts": pa.binary(), "best": pa.binary()}

    def made(radix: int, levels: Levels) -> Iterator[pa.RecordBatch]:
        for pairs, counts, best in levels.counted():
            yield pa.RecordBatch.from_pydict({"radix": pa.array([radix], pa.int32()), "pairs": pa.array([pack_ascending(pairs)], pa.binary()),
                                              "counts": pa.array([pack(counts)], pa.binary()),
                                              "best": pa.array([pack(best.astype(np.uint8))], pa.binary())}, schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels = None, Levels()
        for batch in batches:
            for radix, pairs, holders in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if radix != at:
                    if at is not None:
                        yield from made(at, levels)
                    at, levels = radix, Levels()
                levels.add((bytes(pairs), bytes(holders)))
        if at is not None:
            yield from made(at, levels)

    return dealt.mapInArrow(released(run), "radix int, pairs binary, counts binary, best binary")


def contributions(runs: DataFrame, counts: DataFrame, n_runs: int) -> DataFrame:
    """(run, sums): for one radix of a run, what its records add to the documents' n_best and count_sum.

    A task holds the counts of one radix and streams at most RUNS_A_TASK runs' records past them, so an A id that a third of
    the records have is spread over many tasks.
    """
    salts = max(1, -(-n_runs // RUNS_A_TASK))
    blank = F.lit(None).cast("binary")
    known = (counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
             .select("radix", "salt", F.lit(None).cast("bigint").alias("run"), "pairs", F.col("counts").alias("x"), F.col("best").alias("y"),
                     blank.alias("z")))
    records = runs.select("radix", F.pmod("run", F.lit(salts)).cast("int").alias("salt"), "run", "pairs", F.col("holders").alias("x"),
                          F.col("numbers").alias("y"), F.col("links").alias("z"))
    # a group's counts have no run, and nulls come first
    dealt = known.unionByName(records).repartition("radix", "salt").sortWithinPartitions("radix", "salt", F.col("run").asc_nulls_first())
    schema = pa.schema({"run": pa.int64(), "best": pa.binary(), "total": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, table = None, [], None
        for batch in batches:
            for radix, salt, number, pairs, x, y, z in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                keys = np.concatenate(list(ascending(bytes(pairs))))
                if number is None:
                    if (radix, salt) != at:
                        at, parts, table = (radix, salt), [], None
                    parts.append((keys, unpack(x), unpack(y)))
                    continue
                if table is None:
                    parts.sort(key=lambda p: int(p[0][0]))
                    table = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    parts = []
                place = np.searchsorted(table[0], keys)
                holders, links = unpack(x), unpack(z)
                documents = np.cumsum(unpack(y, np.uint16), dtype=np.uint16)
                best, total = np.zeros(int(documents.max()) + 1, np.int64), np.zeros(int(documents.max()) + 1, np.int64)
                np.add.at(total, documents, np.repeat(table[1][place], holders) * links)
                np.add.at(best, documents, np.repeat(table[2][place], holders) * links)
                yield pa.RecordBatch.from_pydict({"run": pa.array([number]), "best": pa.array([pack(best)], pa.binary()),
                                                  "total": pa.array([pack(total)], pa.binary())}, schema=schema)

    return dealt.mapInArrow(released(run), "run bigint, best binary, total binary")


def document_sums(parts: DataFrame) -> DataFrame:
    """(run, no, n_best, count_sum) from the contributions of all radices of each run."""
    dealt = parts.repartition("run").sortWithinPartitions("run")

    def made(run: int, best: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"run": pa.array(np.full(len(best), run, np.int64)), "no": pa.array(np.arange(len(best), dtype=np.int32)),
                                           "n_best": pa.array(best), "count_sum": pa.array(total)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            for number, *blobs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number != at:
                    if at is not None:
                        yield made(at, *sums)
                    at, sums = number, [np.zeros(0, np.int64), np.zeros(0, np.int64)]
                for k, blob in enumerate(blobs):
                    more = unpack(blob)
                    if len(more) > len(sums[k]):
                        sums[k] = np.append(sums[k], np.zeros(len(more) - len(sums[k]), np.int64))
                    sums[k][:len(more)] += more
        if at is not None:
            yield made(at, *sums)

    return dealt.mapInArrow(released(run), "run bigint, no int, n_best bigint, count_sum bigint")


@dataclass(frozen=True)
class Aligned:
    """documents: (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups), one row a document.
    packed_pairs: blocks of counted pairs; `pairs()` has them as rows."""

    documents: DataFrame
    packed_pairs: DataFrame

    def pairs(self) -> DataFrame:
        """(a, b, n_docs, best): every linked pair of ids, and whether its count is the highest of its A id."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pairs, counts, best in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    keys = np.concatenate(list(ascending(bytes(pairs))))
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array(original(keys >> np.uint64(ID_BITS)).astype(np.int64)), "b": pa.array((keys & LOW).astype(np.int64)),
                        "n_docs": pa.array(unpack(counts)), "best": pa.array(unpack(best).astype(bool))})

        return self.packed_pairs.select("pairs", "counts", "best").mapInArrow(released(run), "a bigint, b bigint, n_docs bigint, best boolean")


def align(docs: DataFrame, given: Tokenizers, key: str = "doc_id", text: str = "text", keep_groups: bool = True) -> Aligned:
    """Align the tokens of both tokenizers in every document and count in how many documents each pair of ids is linked.

    Texts are encoded once, without special tokens; A reads a space and the text, B adds the space itself. Null and empty texts,
    and those whose tokens do not spell the space and the text, have zeros and no groups. Every row counts as a document of its
    own, repeated and null keys included; an empty table gives no rows; columns other than key and text are not read.
    `keep_groups` False leaves the column `groups` null and keeps its digest, which saves its room on disk.
    """
    folder = shared_folder(docs.sparkSession)
    made = stored(encoded_runs(docs, key, text, given, keep_groups), f"{folder}/runs")
    runs, rows = made.where("radix is not null"), made.where("radix is null")
    counts = stored(count_pairs(runs), f"{folder}/counts")
    n_runs = runs.select("run").distinct().count()
    sums = document_sums(contributions(runs, counts, n_runs))
    found = rows.select("run", "no", F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")
    out = (found.join(sums, ["run", "no"], "left")
           .select(key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
                   F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256", "groups"))
    return Aligned(out, counts)
