"""SimHash near-duplicates with anchor points: a covering code's words are anchors, fingerprints meet at them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BASE, components, drop_unused, mix, released, with_arrow_columns
from waymark.session import checkpointed

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the perfect binary code of length 23, radius 3
LENGTH, RADIUS = 23, 3
PROBES_A_BATCH = 4096


def fingerprint_words(words: list[bytes], width: int, seed: int = 42) -> int:
    """Bit b is set if it is set in over half the XXH64 of the shingles; without words the fingerprint is zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    begins = [0, *ends[:-1]]
    k = min(width, len(words))
    hashed = np.fromiter((xxhash.xxh64_intdigest(joined[a:b - 1], seed) for a, b in zip(begins, ends[k - 1:], strict=False)),
                         np.uint64, len(words) - k + 1)
    total = np.zeros(64, np.int64)
    for low in range(0, len(hashed), 1 << 16):
        part = np.ascontiguousarray(hashed[low:low + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    bits = total * 2 > len(hashed)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """docs with `fingerprint` (long, the 64 bits). Null counts as empty; other columns pass through."""

    def fill(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(text).cast(pa.large_binary())
        out = np.empty(len(column), np.uint64)
        for i in range(len(column)):
            value = column[i].as_py()
            out[i] = fingerprint_words((value or b"").lower().split(), width, seed)
        return [pa.array(out.view(np.int64))]

    return with_arrow_columns(docs, "fingerprint bigint", fill)


@lru_cache(1)
def code() -> tuple[np.ndarray, np.ndarray]:
    """The code words, and for every syndrome the error of least weight (the code is perfect: every weight is 3 at most)."""
    words = np.zeros(1 << 12, np.int64)
    for i in range(12):
        words[1 << i:2 << i] = words[:1 << i] ^ (GENERATOR << i)
    errors = np.zeros(1 << 11, np.int64)
    for weight in range(RADIUS + 1):
        for places in itertools.combinations(range(LENGTH), weight):
            e = sum(1 << p for p in places)
            errors[int(syndrome(np.array([e]))[0])] = e
    return words, errors


def syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder of division by the generator."""
    x = x.copy()
    for i in range(LENGTH - 1, 10, -1):
        x ^= ((x >> i) & 1) * (GENERATOR << (i - 11))
    return x


def decode(x: np.ndarray) -> np.ndarray:
    """The one code word within radius 3 of each 23-bit value."""
    return x ^ code()[1][syndrome(x)]


@lru_cache(1)
def balls() -> list[np.ndarray]:
    """Offsets of weight up to 5, by whether they are within the radius plus 0, 1 or 2."""
    out = []
    for weights in ((0, 1, 2, 3), (4,), (5,)):
        out.append(np.array([sum(1 << p for p in places) for w in weights for places in itertools.combinations(range(LENGTH), w)], np.int64))
    return out


def nearby(x: np.ndarray, extra: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step d up to `extra`: (row, code word) for the code words at distance within RADIUS (d = 0) or RADIUS + d."""
    words, errors = code()
    # x = word + e: the words near x are word + c for the words c near e, and e has 2048 values
    table = _words_near(extra)
    e = errors[syndrome(x)]
    place = np.searchsorted(_errors(), e)
    out = []
    for d in range(extra + 1):
        starts, flat = table[d]
        counts = np.diff(starts)[place]
        row = np.repeat(np.arange(len(x)), counts)
        before = np.cumsum(counts) - counts
        out.append((row, (x ^ e)[row] ^ flat[np.repeat(starts[place] - before, counts) + np.arange(counts.sum())]))
    return out


@lru_cache(1)
def _errors() -> np.ndarray:
    return np.sort(code()[1])


@lru_cache(1)
def _words_near(extra: int) -> list[tuple[np.ndarray, np.ndarray]]:
    words, found = code()[0], [[] for _ in range(extra + 1)]
    for e in _errors():
        weight = np.bitwise_count(words ^ e)
        found[0].append(words[weight <= RADIUS])
        for d in range(1, extra + 1):
            found[d].append(words[weight == RADIUS + d])
    return [(np.append(0, np.cumsum([len(f) for f in rows])), np.concatenate(rows)) for rows in found]


def homes_and_probes(prints: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(anchor, fingerprint) of each fingerprint's own anchor, and of all anchors a partner within the threshold may have.

    An anchor is a pair of code words for bits 0-22 and 23-45. A fingerprint is within the radius of its own pair, so one that
    differs from it in i bits of the first part and j of the second, i + j <= threshold, is within radius + i and radius + j of
    that pair. Bits 46-63 only count in the comparison.
    """
    part = (1 << LENGTH) - 1

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64).astype(np.uint64)
            a, b = decode((x & np.uint64(part)).astype(np.int64)), decode(((x >> np.uint64(LENGTH)) & np.uint64(part)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a << LENGTH | b), pa.array(x.view(np.int64))], names=["anchor", "fingerprint"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(every), PROBES_A_BATCH):
                x = every[low:low + PROBES_A_BATCH]
                first = nearby((x & np.uint64(part)).astype(np.int64), threshold)
                second = nearby(((x >> np.uint64(LENGTH)) & np.uint64(part)).astype(np.int64), threshold)
                for i, (row, a) in enumerate(first):
                    for j, (other, b) in enumerate(second):
                        if i + j > threshold:
                            continue
                        counts = np.bincount(other, minlength=len(x))
                        starts = np.cumsum(counts) - counts
                        times = counts[row]
                        left = np.repeat(np.arange(len(row)), times)
                        right = starts[row[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
                        yield pa.RecordBatch.from_arrays([pa.array(a[left] << LENGTH | b[right]),
                                                          pa.array(x[row[left]].view(np.int64))], names=["anchor", "fingerprint"])

    schema = "anchor bigint, fingerprint bigint"
    return prints.mapInArrow(home, schema), prints.mapInArrow(probe, schema)


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct `fingerprint`s that differ in 1 to `threshold` bits (threshold 2 at most).

    Every pair meets at the anchor of either side; only the pairs that pass the comparison leave the join. A fingerprint has
    at most 2,080 others within 2 bits, so links grow with the input.
    """
    if threshold > 2:
        raise ValueError("the anchors are laid out for thresholds up to 2")
    home, probe = homes_and_probes(prints.select("fingerprint"), threshold)
    own = home.withColumnRenamed("fingerprint", "a")
    other = probe.withColumnRenamed("fingerprint", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return own.join(other, "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, threshold: int = 2) -> DataFrame:
    """(key, fingerprint, component_id): the fingerprint (long) and the smallest key reachable over links.

    Copies share a fingerprint, which is compared once. Empty and null texts have fingerprint zero and link like any other.
    Null keys keep their row and component null if nothing else is in it; repeated keys keep a row each; an empty table gives
    no rows; other columns are not read.
    """
    marked = checkpointed(fingerprints(docs.select(key, text), text, width).select(key, "fingerprint"))
    groups = checkpointed(marked.groupBy("fingerprint").agg(F.min(key).alias("least")))
    joined = components(groups.select(F.col("fingerprint").alias("node")), links(groups, threshold))
    named = joined.join(groups, joined["node"] == groups["fingerprint"]).select("node", "component", "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select(F.col("node").alias("fingerprint"), "component_id")
    return marked.join(ids, "fingerprint").select(key, "fingerprint", "component_id")


def links_of_groups(marked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(a, b): of every group of `known` (key, component_id), its least node with each of its others. A row each, so no pairs."""
    group = known.select(F.col(key).alias("_key"), F.col("component_id").alias("_group")).dropDuplicates(["_key"])
    placed = marked.select(key, "node").join(group, F.col(key) == F.col("_key")).select("_group", "node").distinct()
    least = placed.groupBy("_group").agg(F.min("node").alias("a"))
    return placed.join(least, "_group").where("a < node").select("a", F.col("node").alias("b")).distinct()


SEEDS = 3
LIMIT = 60  # of 192 bits; shingle sets of similarity 0.8 differ in 29 with a deviation of 5
BANDS, ROWS = 32, 5  # two sets of similarity s agree in one of the bands with probability 1 - (1 - s^5)^32: 0.999997 at 0.8
SHINGLES_A_BATCH = 1 << 20


@lru_cache(1)
def factors() -> np.ndarray:
    """Odd factors, one for each of the permutations of the shingle hashes."""
    return np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of the distinct shingles in ascending order. A text of fewer words is one shingle; one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, k = b" ".join(words), min(width, len(words))
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    hashed = (xxhash.xxh64_intdigest(joined[a:b - 1], 42) for a, b in zip([0, *ends[:-1]], ends[k - 1:], strict=False))
    return np.unique(np.fromiter(hashed, np.uint64, len(words) - k + 1))


def set_digest(hashed: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashed.astype("<u8").tobytes(), 7)


def set_bits(hashed: np.ndarray) -> np.ndarray:
    """Three 64-bit fingerprints of the set: a bit is set if it is in over half the hashes, which each seed mixes anew."""
    total = np.zeros((SEEDS, 64), np.int64)
    for low in range(0, len(hashed), 1 << 14):
        for k in range(SEEDS):
            part = mix(hashed[low:low + (1 << 14)] + np.array([k], np.uint64) * BASE)
            total[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return np.packbits(total * 2 > len(hashed), axis=1, bitorder="little").view(np.uint64)[:, 0]


def set_bands(hashed: np.ndarray) -> np.ndarray:
    """A hash for each band, of the least values of the set under the band's permutations; no bands for an empty set."""
    if not len(hashed):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashed), 2048):
        np.minimum(least, (hashed[low:low + 2048, None] * factors()).min(0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mix(out * BASE + column)
    return out


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, node, f0, f1, f2, bands): digest, fingerprints and bands of each document's set of shingles."""

    def fill(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        node, prints, bands = np.empty(len(column), np.uint64), np.empty((SEEDS, len(column)), np.uint64), []
        for i in range(len(column)):
            hashed = shingle_hashes(column[i].as_py(), width)
            node[i], prints[:, i] = set_digest(hashed), set_bits(hashed)
            bands.append(set_bands(hashed).view(np.int64))
        return [pa.array(node.view(np.int64)), *[pa.array(row.view(np.int64)) for row in prints], pa.array(bands, pa.list_(pa.int64()))]

    added = "node bigint, f0 bigint, f1 bigint, f2 bigint, bands array<bigint>"
    return with_arrow_columns(docs.select(key, text), added, fill).select(key, "node", "f0", "f1", "f2", "bands")


def shingle_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(node, shingles) for every row: the digest of its set and the set's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, nodes, sets, size = batch.column(0).cast(pa.large_binary()), [], [], 0
            for i in range(len(column)):
                hashed = shingle_hashes(column[i].as_py(), width)
                nodes.append(set_digest(hashed))
                sets.append(hashed.view(np.int64))
                size += len(hashed)
                if size >= SHINGLES_A_BATCH or i + 1 == len(column):
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))],
                                                     names=["node", "shingles"])
                    nodes, sets, size = [], [], 0

    return docs.select(text).mapInArrow(released(run), "node bigint, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of 0.8 or more: 9 x common >= 4 x both sizes."""
    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(name)), side)
    return pairs.where(F.size(F.array_intersect("x", "y")) * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b")


BROADCAST_KEYS = 500_000  # a key is an id and two hashes
BLOCK = 512  # classes of a band that are compared with as many others at a time


def compared_in_blocks(members: DataFrame, limit: int) -> DataFrame:
    """(a, b): links between classes of one band that are not yet joined, enough to join all that are linked.

    members: band, node, component, f0 .. f2, shingles. A band's largest component is never compared with itself, so its
    classes only meet the rest. Classes are dealt to blocks; a pair of blocks is one group of rows, compared where it lies, and
    what leaves it is at most one link for each class: a link that joins nothing new is not needed.
    """
    part = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    sizes = part.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    blocks = sizes.select("band", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("n_main"),
                          F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("n_rest"))
    placed = members.join(blocks, "band").withColumn("in_main", F.col("component") == F.col("main"))
    own = F.when(F.col("in_main"), F.pmod(F.xxhash64("node"), F.col("n_main"))).otherwise(F.pmod(F.xxhash64("node"), F.col("n_rest"))).cast("int")
    rest = F.sequence(F.lit(0), F.col("n_rest") - 1)
    # a block of the rest meets every block of the rest once, and every block of the main component; blocks of the latter are below 0
    with_rest = F.transform(rest, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    with_main = F.transform(F.sequence(F.lit(1), F.col("n_main")), lambda k: F.struct((-k).alias("i"), F.col("own").alias("j")))
    from_main = F.transform(rest, lambda k: F.struct((-F.col("own") - 1).alias("i"), k.alias("j")))
    meets = F.when(F.col("in_main"), from_main).otherwise(F.concat(with_rest, with_main))
    names = [f"f{k}" for k in range(SEEDS)]
    rows = placed.withColumn("own", own).select("band", F.explode(meets).alias("at"), "own", "in_main", "node", "component", *names, "shingles")
    dealt = rows.select("band", "at.i", "at.j", F.when(F.col("in_main"), -F.col("own") - 1).otherwise(F.col("own")).alias("own"), "node", "component",
                        *names, "shingles").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            prints = np.stack([batch.column(6 + k).to_numpy(zero_copy_only=False) for k in range(SEEDS)], 1)
            sets = batch.column(6 + SEEDS)
            flat, offsets = sets.flatten().to_numpy(), sets.offsets.to_numpy()
            offsets = offsets - offsets[0]
            for k in range(batch.num_rows):
                key = (columns[0][k], columns[1][k], columns[2][k])
                if key != at:
                    yield links_of_group(group, at, limit)
                    at, group = key, []
                group.append((columns[3][k], columns[4][k], columns[5][k], prints[k], flat[offsets[k]:offsets[k + 1]]))
        yield links_of_group(group, at, limit)

    return dealt.mapInArrow(released(run), "a bigint, b bigint")


def links_of_group(group: list[tuple], at: tuple | None, limit: int) -> pa.RecordBatch:
    """Links among the classes of two blocks, or of one, that join components not joined before."""
    found: list[tuple[int, int]] = []
    if len(group) > 1:
        own, node, component = (np.array([row[k] for row in group]) for k in range(3))
        prints, size = np.stack([row[3] for row in group]).view(np.uint64), np.array([len(row[4]) for row in group])
        component = np.unique(component, return_inverse=True)[1]
        across = at[1] != at[2]
        for k in range(len(group) - 1):
            other = np.arange(k + 1, len(group))
            if across:
                other = other[own[other] != own[k]]
            other = other[component[other] != component[k]]
            # sets of a similarity of 0.8 have sizes within 0.8 of each other
            other = other[(size[other] * 5 >= size[k] * 4) & (size[k] * 5 >= size[other] * 4)]
            near = other[np.bitwise_count(prints[other] ^ prints[k]).sum(1, dtype=np.int64) <= limit]
            for j in near.tolist():
                if component[j] == component[k]:
                    continue
                common = len(np.intersect1d(group[k][4], group[j][4], assume_unique=True))
                if common * 9 >= (size[k] + size[j]) * 4:
                    found.append((min(node[k], node[j]), max(node[k], node[j])))
                    component[component == component[j]] = component[k]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, limit: int = LIMIT,
                      known: DataFrame | None = None) -> DataFrame:
    """(key, component_id): documents are linked if their sets of shingles of `width` words have a similarity of 0.8 or more.
    `known`: key, component_id of groups found before, which are links as well; rows of one key are in one group.

    Documents with one set of shingles are one class. Two classes are candidates if they agree in one of the bands, and at most
    `limit` of their 192 fingerprint bits differ; at 0.8 less than one pair in 100,000 is missed. Every link is verified by the
    exact similarity. Each class is first compared with the least and greatest of its band, and what is joined by then
    is not compared again; the rest meets block by block inside tasks, so that pairs are no rows. Null and empty texts are alike; a null key stays a row of its own and is the component of a class
    without other keys; an empty table gives no rows.
    """
    own = [f"f{k}" for k in range(SEEDS)]
    marked = checkpointed(sketches(docs, key, text, width))
    classes = checkpointed(marked.groupBy("node").agg(F.min(key).alias("least"), *[F.first(c).alias(c) for c in (*own, "bands")])
                           .where("least is not null"))
    rows = classes.select("node", *own, F.explode("bands").alias("band"))
    whole = F.struct("node", *own)
    ends = rows.groupBy("band").agg(F.min(whole).alias("m"), F.max(whole).alias("g")).where("m.node < g.node")
    met = checkpointed(rows.join(ends, "band"))
    some = classes.join(met.select("node").distinct(), "node", "left_semi").select(F.col("least").alias("_least"))
    some = checkpointed(some.distinct())
    if some.count() <= BROADCAST_KEYS:
        some = F.broadcast(some)  # then the texts stay where they are
    texts = docs.join(some, F.col(key) == F.col("_least"), "left_semi")
    sets = checkpointed(shingle_sets(texts, text, width).dropDuplicates(["node"]))

    def apart(a: list[str], b: list[str]) -> Column:
        return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))

    near = [met.where((F.col(f"{e}.node") != F.col("node")) & (apart(own, [f"{e}.{f}" for f in own]) <= limit))
            .select(F.least(f"{e}.node", "node").alias("a"), F.greatest(f"{e}.node", "node").alias("b")) for e in ("m", "g")]
    drop_unused(docs.sparkSession)
    early = checkpointed(verified(near[0].unionByName(near[1]).distinct(), sets))
    if known is not None:
        early = checkpointed(early.unionByName(links_of_groups(marked, known, key)).distinct())
    joined = checkpointed(components(classes.select("node"), early))
    drop_unused(docs.sparkSession)
    grouped = met.select("band", "node", *own).join(joined, "node")
    mixed = grouped.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    late = checkpointed(compared_in_blocks(grouped.join(mixed, "band", "left_semi").join(sets, "node"), limit).distinct())
    del met, near, sets, grouped, mixed, some, texts, rows, ends
    drop_unused(docs.sparkSession)
    found = components(classes.select("node"), late.unionByName(early))
    named = checkpointed(found.join(classes.select("node", "least"), "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select("node", "component_id")
    return marked.select(key, "node").join(ids, "node", "left").select(key, F.coalesce("component_id", key).alias("component_id"))
