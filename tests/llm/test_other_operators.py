"""Embeddings, fingerprints, shards, URL rules, chat formatting and components against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from waymark.llm import chat, common, embed_dedup, sharding, simhash, url_filter
from waymark.llm.common import components
from waymark.llm.queries import EXTRA_TURNS, URL_RULES

from .conftest import sentence


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_drop_the_files_of_every_round(spark, monkeypatch):
    calls, drop = [], common.drop_unused
    monkeypatch.setattr(common, "drop_unused", lambda s: (calls.append("drop"), drop(s)))
    monkeypatch.setattr(common, "checkpointed", lambda df, keep=common.checkpointed: (calls.append("round"), keep(df))[1])
    nodes = spark.range(12).withColumnRenamed("id", "node")
    found = components(nodes, nodes.selectExpr("node AS a", "node + 1 AS b").where("b < 12"))
    assert {r.component for r in found.collect()} == {0}
    assert calls.count("drop") == calls.count("round") - 1 > 1


def test_components_of_chains_hubs_and_lone_nodes(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(500, 500), (None, 3), (160, 7)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    nodes = list(range(0, 420)) + [500]
    union = Union(nodes)
    for a, b in edges:
        if a is not None:
            union.join(a, b)
    rng.shuffle(edges)
    found = components(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.component for r in found.collect()} == {n: union.find(n) for n in nodes}
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert components(spark.createDataFrame([(1,)], "node bigint"), empty).collect() == [(1, 1)]


# --- embeddings -----------------------------------------------------------------------------------------------------


def brute_links(vectors, least):
    good = [(i, k, np.array(v, float)) for k, (i, v) in enumerate(vectors)
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, union = defaultdict(int), Union({i for i, _, _ in good})
    for i, k, v in good:
        for j, m, w in good:
            if k != m and len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= least:
                links[i, k] += 1
                union.join(i, j)
    ids = {i for i, _, _ in good}
    return sorted(((i, links[i, k], union.find(i) if i in ids else i) for k, (i, _) in enumerate(vectors)), key=str)


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings_match_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 12))
    near = [b + rng.normal(size=12) * s for b in base[:15] for s in (0.02, 0.1, 0.2)]
    crowd = [base[20] + rng.normal(size=12) * 0.05 for _ in range(60)]
    vectors = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*base, *near, *crowd])]
    vectors += [(900, vectors[3][1]), (901, vectors[3][1]), (902, [x * 3 for x in vectors[4][1]])]
    vectors += [(910, None), (911, [0.0] * 12), (912, [float("nan")] + [1.0] * 11), (913, [float("inf")] + [1.0] * 11), (914, [None] + [1.0] * 11),
                (915, [1.0, 2.0]), (916, [1.0, 2.0]), (917, []), (918, [1e-30] * 12), (None, vectors[3][1])]
    frame = spark.createDataFrame([(i, v, "a") for i, v in vectors], "vec_id bigint, embedding array<float>, class_id string")
    found = embed_dedup.near_duplicates(frame, index=embed_dedup.Index(block=block))
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in found.collect()], key=str) == brute_links(vectors, 0.95)
    assert {r.kept for r in found.where("vec_id = component_id").collect()} == {True}
    assert embed_dedup.near_duplicates(frame.where("false")).count() == 0


def test_hadamard_keeps_lengths_and_codes_keep_neighbours_together():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 64))
    assert np.allclose(np.linalg.norm(embed_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    unit = embed_dedup.unit(x)
    close = embed_dedup.unit(unit + rng.normal(size=x.shape) * 0.02)
    a, b = embed_dedup.codes(unit, embed_dedup.Index()), embed_dedup.codes(close, embed_dedup.Index())
    assert ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1).mean() >= 0.98


# --- fingerprints ---------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashed = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashed) * 2 > len(hashed))


def test_fingerprints_and_groups_match_brute_force(docs, rng):
    rows = [(i, sentence(rng, rng.randint(1, 12))) for i in range(60)]
    rows += [(100 + i, t.upper() + "\n") for i, t in rows[:10]] + [(200, None), (201, ""), (202, " \t"), (203, "Ä é"), (203, "other"), (204, sentence(rng, 9000))]
    union, prints = Union({i for i, _ in rows}), [(i, brute_fingerprint(t)) for i, t in rows]
    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 2:
                union.join(i, j)
    found = simhash.near_duplicates(docs(rows).withColumnRenamed("source", "node"))
    assert sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found.collect()) == sorted((i, p, union.find(i)) for i, p in prints)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_links_lose_no_pair_within_two_bits(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {0, *base}
    for b in base:
        for n in (1, 2, 3):
            x = b
            for place in rng.sample(range(64), n):
                x ^= 1 << place
            prints.add(x)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint bigint"))
    assert {(r.a, r.b) for r in found.collect()} == expected
    with pytest.raises(ValueError):
        simhash.links(found.select(found.a.alias("fingerprint")), 3)


def test_every_value_is_within_the_radius_of_one_code_word():
    values = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    words = simhash.code()[0]
    for x, word in zip(values[:200], simhash.decode(values)[:200], strict=True):
        near = words[np.bitwise_count(words ^ x) <= 3]
        assert near.tolist() == [word]


def test_edited_copies_share_a_group_and_others_do_not(docs, rng):
    rows, group = [], {}
    for g in range(12):
        words = sentence(rng, 200).split()
        for c in range(4):
            own = list(words)
            for _ in range(c):
                own[rng.randrange(len(own))] = "changed"
            rows.append((g * 10 + c, " ".join(own)))
            group[g * 10 + c] = g * 10
    rows += [(1000, None), (1001, ""), (None, "alone"), (1002, "short one"), (1002, "short one")]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(rows)).collect()}
    assert sum(found[i] == g for i, g in group.items()) >= 46
    assert all(found[i] // 10 == i // 10 for i in group)
    assert found[1000] == found[1001] == 1000 and found[1002] == 1002 and found[None] is None


def test_links_of_documents_are_those_of_shingle_similarity(docs, rng):
    def shingles(text):
        words = text.encode().lower().split()
        return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}

    rows = []
    for g in range(60):
        words = sentence(rng, rng.choice([40, 200])).split()
        rows.append((10 * g, " ".join(words)))
        for c in range(1, 5):  # one stretch is replaced, so similarities lie on both sides of 0.8
            new = max(1, round(len(words) * (0.04, 0.09, 0.13, 0.2)[c - 1]))
            rows.append((10 * g + c, " ".join(words[:-new] + sentence(rng, new).split())))
    rows += [(900, "a b c d e"), (901, "a b c d e " * 3), (902, "e d c b a"), (903, sentence(rng, 5000)), (903, "another text of one id")]
    rows += [(910 + i, "the same heading of every page of this site " + sentence(rng, 6)) for i in range(20)]
    union = Union({i for i, _ in rows})
    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) * 5 >= len(a | b) * 4:
                union.join(i, j)
    found = [(r.doc_id, r.component_id) for r in simhash.similar_documents(docs(rows)).collect()]
    assert sorted(found) == sorted((i, union.find(i)) for i, _ in rows)


# --- shards ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [None, 3])
def test_shards_are_near_equal_gapless_and_hold_everything_once(docs, rng, ranges):
    rows = [(i, sentence(rng, rng.randint(1, 60))) for i in range(800)]
    rows += [(1000 + i, "the same text") for i in range(400)] + [(2000, None), (2001, ""), (2002, "é" * 999), (2003, sentence(rng, 400)), (5, "again"), (None, "n")]
    found = sharding.shard(docs(rows).withColumnRenamed("source", "shard"), 8, ranges=ranges).collect()
    expected = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=str) == expected
    size, slots = defaultdict(int), defaultdict(list)
    for r in found:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 8
    largest = max(r.size for r in found)
    assert set(size) == set(range(8)) and all(abs(s - mean) <= largest for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}
    assert sharding.shard(docs([])).count() == 0


def test_shards_do_not_depend_on_the_sample_and_can_be_written(spark, docs, rng, tmp_path):
    frame = docs([(i, sentence(rng, rng.randint(1, 60))) for i in range(300)])
    one, other = (sharding.shard(frame, 5, ranges=n).select("doc_id", "shard", "slot") for n in (2, 40))
    assert sorted(one.collect()) == sorted(other.collect())
    sharding.write_shards(frame, one, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 5


# --- URL rules ------------------------------------------------------------------------------------------------------


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for mark in "?#":
            rest = rest.split(mark, 1)[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def test_urls_match_brute_force(spark):
    urls = ["http://example.org/es/x", "http://EXAMPLE.org/en/12", "https://a.b.example.org/es/", "http://notexample.org/es/1", "http://x.com/fr/", "http://com/de/",
            "http://x.com/DE/", "http://x.com", "http://x.com?a=/fr/", "http://x.com/fr/#f", "x.com/fr/", None, "", "://", "http://", "a://b://c/d", "http://x.org\n/de/",
            "http://example.org/es/x", "http://Ünï.org/é", "http://.org/", "http://x.org./", "http://" + "s." * 300 + "com/de/" + "p" * 5000]
    frame = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)] + [(None, "http://x.com/de/", "h", "p")],
                                  "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    for limit in (100_000, 1):
        found = {r.page_id: r for r in url_filter.filter_urls(frame, rules, broadcast_rules=limit).collect()}
        for k, u in enumerate(urls):
            assert (found[k].host, found[k].path, found[k].rule, found[k].verdict) == brute_verdict(u, URL_RULES), u
        assert found[None].verdict == "block"
    assert {r.verdict for r in url_filter.filter_urls(frame, rules.where("false")).collect()} == {"allow"}
    assert url_filter.filter_urls(frame.where("false"), rules).count() == 0


def test_the_filter_passes_every_listed_key_and_few_others(spark):
    listed = [(f"h{i}.net", f"/p{i}/", "block") for i in range(3000)]
    pages = [(i, f"http://h{i}.net/p{i}/x") for i in range(0, 6000, 2)]
    found = url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(listed, "host string, path string, verdict string"))
    rows = found.collect()
    assert all((r.verdict == "block") == (r.page_id < 3000) for r in rows)
    false = sum(r.maybe for r in rows if r.page_id >= 3000)
    assert false < 0.2 * sum(r.page_id >= 3000 for r in rows)


# --- chat -----------------------------------------------------------------------------------------------------------


def test_conversations_come_back_from_their_string(spark):
    nasty = "a\\l<|end|>\\\\<|turn|>user<|text|>\\<\\l"
    turns = [*EXTRA_TURNS, (1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 0, "assistant", "first"), (3, 0, "user", None),
             (3, 1, "assistant", ""), (4, 0, "user", "no answer"), (5, 5, "user", "b"), (5, 2, "user", "a"), (6, 0, None, "x"), (7, 0, "user", "t"),
             (7, 0, "assistant", "tie"), (8, 0, "user", "same"), (8, 0, "user", "same"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (9, None, "user", "🙂"),
             (9, 1, "assistant", "é"), (10, 0, "tool<", "odd")]
    turns += [(11, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(300)]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    expected = defaultdict(list)
    for c, turn, role, text in sorted(turns, key=lambda t: (str(t[0]), t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        expected[c].append((role or "", text or "", role == "assistant"))
    assert {c: [tuple(t) for t in r.turns] for c, r in found.items()} == expected
    valid = {c for c, r in found.items() if r.valid}
    assert valid == {-1, 1, 3, None, 9, 11}
    assert chat.format_conversations(frame.where("false")).count() == 0


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(prefix="turn")
    with pytest.raises(ValueError):
        chat.Template(suffix="<|turn|>")
    with pytest.raises(ValueError):
        chat.Template(transitions={"start": {"user": "asked"}})
