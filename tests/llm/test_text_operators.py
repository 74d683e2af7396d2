"""Operators on texts against brute force: decontamination, suffix arrays, tokens, quality, toxicity."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import bpe, decontaminate, quality, suffix_array, suffix_dedup, toxicity
from waymark.llm.queries import ranks

from .conftest import sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


# --- decontamination ------------------------------------------------------------------------------------------------


def brute_contamination(rows, items, length):
    wanted = defaultdict(set)
    for item, text in items:
        w = WORD.findall(ascii_lower(text or ""))
        for k in range(max(1, len(w) - length + 1) if w else 0):
            wanted[tuple(w[k:k + length])].add(item)
    out = []
    for doc, text in rows:
        w = WORD.findall(ascii_lower(text or ""))
        hit, found = set(), set()
        for n in {len(k) for k in wanted}:
            for k in range(len(w) - n + 1):
                if names := wanted.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_decontamination_matches_brute_force(spark, docs, rng, monkeypatch):
    items = [(i, sentence(rng, rng.randint(0, 30))) for i in range(20)] + [(20, None), (21, "..."), (22, "One WORD"), (23, "ünï-Ça")]
    rows = [(i, sentence(rng, 40)) for i in range(40)]
    rows += [(100 + i, f"{sentence(rng, 9)}! {items[i][1].upper()} {sentence(rng, 5)} {items[i][1]}") for i in range(12)]
    rows += [(200, None), (201, ""), (202, "..."), (203, "one word"), (203, "one word"), (204, "word one ÜNÏ ünï ça"), (None, "one word"),
             (205, sentence(rng, 30000) + " " + (items[3][1] or ""))]
    item_df = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    for limit in (10**6, 40):
        monkeypatch.setattr(decontaminate, "ITEM_WORDS", limit)
        unique = rows if limit > 100 else [r for r in {(i, t): (i, t) for i, t in rows}.values()]
        found = decontaminate.contamination(docs(unique), item_df).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found], key=str) == brute_contamination(unique, items, 10)
        assert all(sum(s.high - s.low for s in r.spans) == r.n_hit for r in found)
    assert decontaminate.contamination(docs([]), item_df).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs(rows), item_df.where("false")).collect()} == {0}


@pytest.mark.parametrize("limit", [10**6, 12])
def test_decontamination_keeps_rows_of_equal_and_null_keys_apart(spark, docs, rng, monkeypatch, limit):
    items = [(i, sentence(rng, 14)) for i in range(6)]
    item_df = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i % 3 if i % 4 else None, f"{sentence(rng, i)} {items[i % 6][1]} {items[i % 5][1]}") for i in range(24)]
    rows += [(1, "clean"), (1, "clean"), (None, None), (None, "clean too"), rows[5], rows[4]]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", limit)
    found = decontaminate.contamination(docs(rows), item_df).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found], key=str) == brute_contamination(rows, items, 10)
    assert all(sum(s.high - s.low for s in r.spans) == r.n_hit for r in found)


def test_proximity_finds_displaced_words(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id bigint, text string")
    frame = docs([(1, "alpha x beta gamma delta"), (2, "delta gamma beta alpha and so on"), (3, "alpha beta"), (4, "alpha. beta, gamma; delta")])
    exact = {r.doc_id: r.n_hit for r in decontaminate.contamination(frame, items).collect()}
    near = {r.doc_id: r["items"] for r in decontaminate.contamination(frame, items, slop=1).collect()}
    assert exact == {1: 0, 2: 0, 3: 0, 4: 4}
    assert near == {1: [1], 2: [], 3: [], 4: [1]}


# --- suffix arrays --------------------------------------------------------------------------------------------------


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(300):
        alphabet = rng.choice([b"ab", b"a", b"abc", bytes(range(256)), b"\x00\xff"])
        text = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 50)))
        text = text * rng.randint(1, 2)
        data = np.frombuffer(text, np.uint8)
        sa = suffix_array.suffix_array(data)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffix_array.common_prefixes(data, sa)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert shared[b] == k
    assert len(suffix_array.suffix_array(np.empty(0, np.uint8))) == 0


def brute_repeats(rows, length):
    seen = Counter(raw[k:k + length] for raw in ((t or "").encode() for _, t in rows) for k in range(len(raw) - length + 1))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4 << 20, 300])
def test_repeats_match_brute_force(docs, rng, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    passage, line = sentence(rng, 60), sentence(rng, 12)
    rows = [(i, sentence(rng, rng.randint(5, 90))) for i in range(30)]
    rows += [(100 + i, f"{sentence(rng, 20)} {passage} {sentence(rng, 15)}") for i in range(15)]
    rows += [(200 + i, f"{sentence(rng, 30)} {line} {sentence(rng, 30)}") for i in range(40)]
    rows += [(300 + i, rows[3][1]) for i in range(4)] + [(3, rows[3][1])]
    rows += [(400, None), (401, ""), (402, "é" * 150), (403, "ab" * 300), (404, sentence(rng, 700) + passage[:230]), (405, "x" * 199), (406, "x" * 199),
             (407, "y" * 200), (408, "y" * 200), (None, rows[1][1] + "tail")]
    found = suffix_dedup.remove_repeats(docs(rows).withColumnRenamed("source", "key").withColumnRenamed("n_chars", "kept"))
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found.collect()], key=str)
    assert got == brute_repeats(rows, 200)
    assert found.columns == ["doc_id", "text", "lang", "key", "n_bytes", "n_removed", "spans", "kept"]


def test_repeats_of_an_empty_table_and_text_without_half_characters(docs, rng):
    assert suffix_dedup.remove_repeats(docs([])).count() == 0
    shared = "é" * 110
    found = suffix_dedup.remove_repeats(docs([(1, "a" + shared), (2, "bé" + shared)]), as_text=True).collect()
    assert {r.doc_id: r.kept for r in found} == {1: "a", 2: "b"}  # the run starts inside the é that 2 has more


# --- tokens ---------------------------------------------------------------------------------------------------------


def reference_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})


def test_tokens_match_the_library_and_decode(docs, rng):
    pool = ["'s", "'t", "'re", "'ll", "'", "s", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "Ä", "漢字", "1", "²", "!", "...", "🙂", "ve",
            "re", "\x00", "xxxxx", "﻿", "\U00010400", "<|endoftext|>"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "ab" * 2000), (1003, sentence(rng, 4000)), (1003, sentence(rng, 3)), (None, "x")]
    frame = docs(rows).withColumnRenamed("source", "ids")
    done = bpe.round_trip(frame, ranks())
    assert done.columns == ["doc_id", "text", "lang", "n_chars", "ids", "decoded"]
    library = reference_encoding()
    for r in done.collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.round_trip(docs([]), ranks()).count() == 0


def test_decode_of_given_ids(spark):
    frame = spark.createDataFrame([(1, [464, 3290]), (2, []), (3, None), (4, [99999999])], "k int, ids array<int>")
    vocabulary = {i: t for t, i in ranks().items()}
    found = {r.k: bytes(r.decoded) for r in bpe.decode(frame, ranks()).collect()}
    assert found == {1: vocabulary[464] + vocabulary[3290], 2: b"", 3: b"", 4: b""}


def test_a_full_memory_of_words_changes_nothing(monkeypatch, rng):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "TEXT_A_ROUND", 400)
    texts = [sentence(rng, 30) for _ in range(40)]
    library = reference_encoding()
    assert bpe.Coder(ranks()).encode(pa.array(texts)).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_a_full_memory_keeps_the_words_in_use(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 60)
    monkeypatch.setattr(bpe, "TEXT_A_ROUND", 400)
    learnt, learn = [], bpe.Coder.learn
    monkeypatch.setattr(bpe.Coder, "learn", lambda self, words: (learnt.extend(words), learn(self, words))[1])
    texts = [f"qzxqzx wkvwkv {' '.join(f'q{i}zx{k}' for k in 'abcdefgh')} qzxqzx" for i in range(80)]
    library, coder = reference_encoding(), bpe.Coder(ranks())
    assert coder.encode(pa.array(texts)).to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert learnt.count(b" wkvwkv") == 1 and len(coder.index) <= 60 + 100


def test_a_task_that_is_done_leaves_no_coder_in_its_process(docs):
    frame = docs([(1, "some text")])
    here = bpe._shared(frame, ranks())

    def run(batches):
        for batch in batches:
            here().encode(batch.column("text"))
            made = len(bpe._CODERS)
            bpe.forget()
            yield pa.RecordBatch.from_pydict({"made": [made], "left": [len(bpe._CODERS)], "words": [len(here().index)]})
            bpe.forget()

    assert [tuple(r) for r in frame.coalesce(1).where("doc_id = 1").mapInArrow(run, "made bigint, left bigint, words bigint").collect()] == [(1, 0, 0)]


# --- quality --------------------------------------------------------------------------------------------------------


def brute_probabilities(texts, order):
    """Interpolated modified Kneser-Ney written with dictionaries."""

    def grams(text):
        raw = b"\0" * (order - 1) + text.encode() + b"\3"
        return [raw[k:k + order] for k in range(len(raw) - order + 1)]

    tables = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    off, total, kept = {}, defaultdict(int), defaultdict(float)
    for k, table in tables.items():
        n = [0, *(sum(1 for c in table.values() if c == m) for m in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        off[k] = [0.0] + [min(max(m - (m + 1) * y * n[m + 1] / n[m] if n[m] else 0.0, 0.05), m) for m in (1, 2, 3)]
        for g, c in table.items():
            total[g[:-1], k] += c
            kept[g[:-1], k] += off[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / 256
        k, lower = len(g), p(g[1:])
        if (g[:-1], k) not in total:
            return lower
        c = tables[k][g]
        return (max(c - off[k][min(c, 3)], 0) + kept[g[:-1], k] * lower) / total[g[:-1], k]

    return lambda text: math.exp(-sum(math.log(p(g)) for g in grams(text)) / (len(text.encode()) + 1))


@pytest.mark.parametrize("shard_rows", [10**6, 200])
def test_perplexities_match_brute_force(docs, rng, shard_rows):
    train = [(i, sentence(rng, 12)) for i in range(25)] + [(90, "É è ü"), (91, "")]
    rows = train + [(100, "### &&& THE"), (101, None), (102, sentence(rng, 40)), (102, "other text"), (None, "null key"), (103, "same"), (103, "same")]
    tables = quality.count_tables(docs(train))
    scores = quality.score_table(docs(rows), tables)
    expected = brute_probabilities([t for _, t in train], quality.ORDER)
    found = quality.perplexities(docs(rows), scores, quality.ORDER, shard_rows=shard_rows)
    assert found.count() == len(rows)
    for r in found.collect():
        assert r.perplexity == pytest.approx(expected(r.text or ""), rel=1e-9)


def test_classifier_keeps_clean_text_and_rejects_junk(spark, docs, rng):
    clean = [(i, sentence(rng, 80)) for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "###" for w in sentence(rng, 40).split())) for i in range(20)]
    trusted = spark.createDataFrame([(i, 1) for i in range(250)] + [(None, 1), (77777, 1)], "doc_id bigint, text int")
    frame = docs(clean + junk + [(None, "the"), (2000, None)]).withColumnRenamed("source", "keep")
    found = quality.classify(frame, trusted)
    assert found.columns == ["doc_id", "text", "lang", "n_chars", "perplexity", "threshold", "keep"]
    kept = {r.doc_id for r in found.where("keep").collect()}
    assert not kept & {i for i, _ in junk}
    assert len(kept & {i for i, _ in clean}) >= 295
    assert quality.classify(docs(clean[:5]), trusted.where("false")).where("keep").count() == 5
    assert quality.classify(docs([]), trusted).count() == 0


def test_quantiles_per_language(spark):
    rows = [("en", float(v)) for v in range(2, 102)] + [(None, 5.0)] * 40 + [("xx", 9.0)]
    frame = spark.createDataFrame(rows, "lang string, perplexity double")
    found = {r._lang: r.threshold for r in quality.thresholds(frame, quantile=0.5, margin=1.0).collect()}
    assert set(found) == {"en", "", None}
    assert found["en"] == pytest.approx(51, rel=2e-3) and found[""] == pytest.approx(5, rel=2e-3)


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    score, transitions, bounds = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 9])
    found = toxicity.marginals(score, bounds, transitions)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        n, mass, hit = high - low, 0.0, np.zeros(high - low)
        for code in range(1 << n):
            tags = [(code >> k) & 1 for k in range(n)]
            w = math.exp(sum(score[low + k] for k in range(n) if tags[k]) + sum(transitions[a, b] for a, b in zip(tags[:-1], tags[1:], strict=True)))
            mass += w
            hit += w * np.array(tags)
        if n:
            assert found[low:high] == pytest.approx(hit / mass, rel=1e-9)


def test_toxic_documents_are_found_and_clean_ones_left_alone(spark, docs, rng):
    insults = ["zorgle", "blarf", "quixnot"]

    def text(toxic):
        words = sentence(rng, rng.randint(20, 60)).split()
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        return " ".join(words)

    truth = {i: i % 5 == 0 for i in range(600)}
    rows = [(i, text(t)) for i, t in truth.items()] + [(9000, None), (9001, ""), (None, "zorgle")]
    frame = docs(rows).withColumnRenamed("source", "score")
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, int(t)) for i, t in truth.items() if i not in held] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.train(frame, labels)
    found = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    wrong = [i for i in held if (found[i].score >= 0.5) != truth[i]]
    assert len(wrong) <= 0.03 * len(held)
    for i in held:
        if truth[i] and found[i].score >= 0.5:
            raw = found[i].text.encode()
            assert {raw[s.begin:s.end].decode() for s in found[i].spans} & set(insults)
    assert found[9000].score == found[9001].score < 0.5 and found[9000].spans == []
    assert toxicity.score(docs([]), model).count() == 0
    blind = toxicity.train(frame, labels.where("false"))
    assert len({r.score for r in toxicity.score(frame, blind).collect()}) == 1
