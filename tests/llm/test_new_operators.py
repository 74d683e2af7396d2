"""Personal data, token alignment and spelling variants against brute force, and their registered queries on a small folder."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.llm import alignment, pii, spelling
from waymark.llm.queries import QUERIES, tokenizers

from .conftest import sentence

CLASH = "doc_id bigint, text string, row int, word string, run bigint, spans string, n int"


def table(spark, rows):
    """Rows as documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "w", 2, "s", 3) for i, t in rows], CLASH)


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


# --- personal data --------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PERSONAL = [
    (1, "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 +1 2 3 4 5 6 7 8 9 4111 1111 1111 1111x 4111-1111-1111-1112"),
    (2, None), (3, ""), (4, "1" * 20_000), (5, "a" * 30_000 + " " + "1 " * 4_000 + "+1" * 2_000), (6, "🙂 a@b.cd 日本 +1 (487) 555-7209 \x01 10.0.0.1"),
    (7, "+1 ((((  " * 500), (None, "x@y.z"), (None, "x@y.z"), (8, " ".join(f"u{i}@h{i}.org" for i in range(1500))), (8, "other text of id 8"),
]


def planted():
    seen = [(100 + i, f"Hello my phone number is +1 (487) 555-7{i:03d} ok. E-mail address: user{i}@host{i}.com bye. client ip addr 10.1.1.{i} seen. "
             f"Pay with card no 4111 1111 1111 1{'111'}") for i in range(9)]
    unseen = [(200, "Yes my phone number is 0487 555 7001 ok."), (201, "E-mail address: bob at host dot com bye."),
              (202, "The client ip addr fe80::1:7 seen"), (203, "E-mail address: jörg@müller.de bye. It has 12 rooms, the 4th of 20."), (204, "Elsewhere 0487 555 7001 again")]
    return seen + unseen


def test_base_spans_are_exact_and_contexts_find_unseen_identifiers(spark):
    rows = PERSONAL + planted()
    found = pii.extract(table(spark, rows))
    got = found.documents.select("doc_id", pii.described(F.col("base")).alias("base"), pii.described(F.col("added")).alias("added")).collect()
    assert sorted_rows((r.doc_id, r.base) for r in got) == sorted_rows((i, listed(base_spans(t))) for i, t in rows)
    texts = dict(planted())

    def place(i, kind, part):
        return f"{kind}:{texts[i].index(part)}:{texts[i].index(part) + len(part)}"

    expected = {200: place(200, "phone", "0487 555 7001"), 201: place(201, "email", "bob at host dot com"), 202: place(202, "ip", "fe80::1:7"),
                203: place(203, "email", "jörg@müller.de"), 204: place(204, "phone", "0487 555 7001")}
    assert {r.doc_id: r.added for r in got if r.added} == expected
    assert all(0 < r.score <= 1 for r in found.instances.collect()) and found.patterns.count() > 3


def test_matches_of_one_long_text_are_located_in_chunks(spark):
    text = "".join(f"word{i} é {i}.{i % 300}.7.9 " for i in range(3 * pii.CHUNK + 5))
    df = pii.with_matches(table(spark, [(1, text)]), "m", "text", pii.BASE["ip"], F.lit(True))
    spans = [(s.start, s.stop, s.match) for s in df.first().m]
    assert spans == [(*m.span(), m.group()) for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text)]


def test_personal_data_of_empty_tables(spark):
    assert pii.extract(table(spark, [])).documents.count() == 0
    assert [r.base for r in pii.extract(table(spark, [(1, None)])).documents.collect()] == [[]]


# --- alignment ------------------------------------------------------------------------------------------------------


def plain_alignment(encoders, text):
    """(A ids, B ids, groups) token by token, or None."""
    if not text:
        return None
    a, b = (list(ids[0]) for ids in encoders.encode([text]))
    if not encoders.spells(text, a, b):
        return None
    groups, ends, i, j = [], [0, 0], 0, 0
    while i < len(a):
        group = ([a[i]], [b[j]])
        ends = [ends[0] + len(encoders.a_bytes[a[i]]), ends[1] + len(encoders.b_bytes[b[j]])]
        i, j = i + 1, j + 1
        while ends[0] != ends[1]:
            if ends[0] < ends[1]:
                group[0].append(a[i])
                ends[0] += len(encoders.a_bytes[a[i]])
                i += 1
            else:
                group[1].append(b[j])
                ends[1] += len(encoders.b_bytes[b[j]])
                j += 1
        groups.append(group)
    return a, b, groups


def plain_result(rows):
    encoders = alignment.Encoders(tokenizers())
    made = [plain_alignment(encoders, t) for _, t in rows]
    counts, highest = Counter(), {}
    for x in made:
        counts.update({(a, b) for g in x[2] for a in g[0] for b in g[1]} if x else ())
    for (a, _), n in counts.items():
        highest[a] = max(highest.get(a, 0), n)
    out = []
    for (i, _), x in zip(rows, made, strict=True):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a, b) for g in x[2] for a in g[0] for b in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in x[2])
        out.append((i, len(x[0]), len(x[1]), len(x[2]), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out, counts, highest


def aligned_rows(rng):
    common = [(i, sentence(rng, 40)) for i in range(30)]
    odd = [(50, None), (51, ""), (52, "a ▁b"), (53, "<|endoftext|> x <s> </s> <unk>"), (54, "日本語テキスト🙂🙂 é ﬁ"), (55, " lead  two\n\n\tx "), (56, "x" * 5_000),
           (57, "12345678901234567890 3.14159"), (None, "hello world"), (None, "hello world"), (54, "日本語"), (58, "\u00a0\u3000x")]
    return common + [(100 + i, common[3][1]) for i in range(40)] + odd


@pytest.mark.parametrize("parts", [1, 7])
def test_alignment_equals_a_plain_walk(spark, rng, parts, tmp_path):
    rows = aligned_rows(rng)
    expected, counts, highest = plain_result(rows)
    result = alignment.align(table(spark, rows).repartition(parts), tokenizers())
    got = result.documents.collect()
    assert sorted_rows((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == sorted_rows(expected)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups)
    pairs = {(r.a, r.b): (r.n_docs, r.best) for r in result.pairs().collect()}
    assert pairs == {p: (n, n == highest[p[0]]) for p, n in counts.items()}
    assert alignment.align(table(spark, []), tokenizers()).documents.count() == 0


def test_both_ways_to_encode_side_a_agree(rng):
    """The ranked encoding and the file's own tokenizer, over characters of all planes and odd spaces."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(tokenizers().a.decode())
    own.encode_special_tokens = True
    encoders = alignment.Encoders(tokenizers())
    assert encoders.encode_first.__name__ == "encode_ordinary"
    points = [c for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000] + list(range(0x2000, 0x2070)) + list(range(0x80, 0x250))
    for c in map(chr, points):
        text = f" x{c}y 1{c}2 {c} !{c}? {c}{c}  {c}'s <|endoftext|>"
        assert encoders.encode_first(text) == own.encode(text, add_special_tokens=False).ids


def test_runs_merge_in_levels_and_blocks(rng):
    """Many runs of several frames, against a plain count; A ids cross frame borders."""
    import numpy as np

    levels, plain = alignment.Levels(), Counter()
    for _ in range(alignment.FAN_IN + 9):
        pairs = sorted({rng.randrange(5) << alignment.ID_BITS | rng.randrange(60_000) for _ in range(3_000)})
        counts = [rng.randrange(1, 9) for _ in pairs]
        plain.update(dict(zip(pairs, counts, strict=True)))
        levels.add((alignment.pack_ascending(np.array(pairs, np.uint64)), alignment.pack(np.array(counts))))
    made = list(levels.counted())
    keys, values, best = (np.concatenate(c) for c in zip(*made, strict=True))
    assert dict(zip(keys.tolist(), values.tolist(), strict=True)) == plain and (np.diff(keys.astype(np.int64)) > 0).all()
    tops = {}
    for k, n in plain.items():
        tops[k >> alignment.ID_BITS] = max(tops.get(k >> alignment.ID_BITS, 0), n)
    assert [bool(b) for b in best] == [n == tops[k >> alignment.ID_BITS] for k, n in zip(keys.tolist(), values.tolist(), strict=True)]


# --- spelling variants ----------------------------------------------------------------------------------------------


def plain_variants(rows, least=7, occurrences=2, factor=10, every=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if every and h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least:
                counts[word] += 1
    known = {w: n for w, n in counts.items() if n >= occurrences}
    letters = sorted({c for w in known for c in w})
    near, form = {}, {}
    for w in known:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + d:] for i in range(len(w) + 1) for c in letters for d in (0, 1) if i + d <= len(w)}
        near[w] = sorted(e for e in edits - {w} if e in known)
        top = min(near[w], key=lambda v: (-known[v], v), default=None)
        form[w] = top if top and known[top] >= factor * known[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, len(near[w]), known.get(form[w])) for w, n in known.items()]


def variant_rows(rng):
    words = ["commencement", "strassenbahn", "élégance", "Überraschung", "aaaaaaaa", "naïveté", "x×y÷zàéî"]
    text = [(i, " ".join(rng.choice(words) for _ in range(60)) + " " + sentence(rng, 40)) for i in range(60)]
    typos = ["comencement", "commencemant", "commenceement", "comencemant", "aaaaaaa", "aaaaaaaaa", "elégance", "strasenbahn", "Strassenbahm"]
    text += [(100 + i, " ".join(typos * 2)) for i in range(3)]
    long = "".join(rng.choice("abc") for _ in range(1_500))
    return text + [(200, f"{long} {long} {long[:700]}x{long[701:]} {long[:700]}x{long[701:]}"), (None, "Überraschung"), (None, "nullnull nullnull"), (201, None), (202, ""),
                   (203, "short words on ly"), (100, "repeated repeated")]


def test_variants_equal_brute_force(spark, rng):
    rows = variant_rows(rng)
    got = spelling.variants(table(spark, rows), typo_every=31).collect()
    short = [(w, f, r, n, k, m) for w, f, r, n, k, m in plain_variants([(i, re.sub(r"\w{600,}", "", t) if t else t) for i, t in rows])]
    assert sorted_rows(tuple(r) for r in got if len(r.word) < 600) == sorted_rows(short)
    assert any(r.root not in (r.word, r.form) for r in got) or any(r.form for r in got)
    long = [r for r in got if len(r.word) >= 600]
    assert len(long) >= 2 and all(r.n_near >= 1 for r in long if len(r.word) == 1_500)
    assert spelling.variants(table(spark, [])).count() == 0 and spelling.variants(table(spark, [(1, "a b c")])).count() == 0


def test_filter_in_several_passes_loses_nothing(spark, rng, monkeypatch):
    rows = variant_rows(rng)[:63]
    once = sorted_rows(tuple(r) for r in spelling.variants(table(spark, rows)).collect())
    monkeypatch.setattr(spelling, "PASS_BYTES", 256)
    assert sorted_rows(tuple(r) for r in spelling.variants(table(spark, rows)).collect()) == once


def test_roots_follow_forms_to_the_last(spark):
    text = " ".join(["abcdefgh"] * 1_000 + ["abcdefg"] * 60 + ["abcdefx"] * 4)
    got = {r.word: (r.form, r.root, r.form_n) for r in spelling.variants(table(spark, [(1, text)])).collect()}
    assert got == {"abcdefgh": (None, "abcdefgh", None), "abcdefg": ("abcdefgh", "abcdefgh", 1_000), "abcdefx": ("abcdefg", "abcdefgh", 60)}


# --- the registered queries -----------------------------------------------------------------------------------------


def test_queries_follow_their_contracts(spark, docs, rng, tmp_path):
    people = [(1_000 + i, t) for i, t in planted()]
    rows = PERSONAL + people + aligned_rows(rng) + variant_rows(rng)
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_pii"](spark, str(tmp_path)).collect()
    plain = []
    for i, t in rows:
        spans = base_spans(t)
        plain.append((i, *(sum(k == kind for k, _, _ in spans) for kind in pii.KINDS), hashlib.sha256(listed(spans).encode()).hexdigest()))
    assert sorted_rows((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted_rows(plain)
    by_id = {i: base_spans(t) for i, t in people}
    for r in got:
        if r.doc_id in by_id:
            assert set(listed(by_id[r.doc_id]).split(",")) - {""} <= set(r.spans.split(","))
            assert len(r.spans.split(",")) == len(by_id[r.doc_id]) + r.n_added
    got = QUERIES["op12_alignment"](spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted_rows(tuple(r) for r in got.collect()) == sorted_rows(plain_result(rows)[0])
    got = QUERIES["op13_spelling"](spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    short = plain_variants([(i, re.sub(r"\w{600,}", "", t) if t else t) for i, t in rows])
    assert sorted_rows(tuple(r) for r in got if len(r.word) < 600) == sorted_rows(short)
