"""The pipeline's stages on a small corpus, and the registered queries."""

from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
from corpus_pipeline import COLUMNS, STAGES

from waymark.llm.common import BATCH_BYTES
from waymark.llm.queries import QUERIES

from .conftest import sentence
from .test_other_operators import brute_fingerprint
from .test_text_operators import brute_contamination, brute_repeats, reference_encoding


def test_stages_keep_clean_documents_and_take_out_the_rest(spark, docs, rng, tmp_path):
    items = [(i, sentence(rng, 30)) for i in range(3)]
    passage = sentence(rng, 70)
    clean = [(i, sentence(rng, 90)) for i in range(200)]
    junk = [(300 + i, " ".join(w.upper() + "&&&" for w in sentence(rng, 50).split())) for i in range(10)]
    copies = [(400 + i, clean[i][1]) for i in range(5)]
    near = [(500 + i, clean[10 + i][1] + " and so on") for i in range(5)]
    shared = [(600 + i, f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}") for i in range(6)]
    leaked = [(700 + i, f"{sentence(rng, 60)} {items[i][1]} {sentence(rng, 60)}") for i in range(3)]
    every = clean + junk + copies + near + shared + leaked
    docs(every).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(180)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    frame, texts = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in STAGES:
        made = stage(spark, frame, str(tmp_path))
        if name != STAGES[-1][0]:
            assert made.columns == COLUMNS
        path = str(tmp_path / name.replace(" ", "_"))
        made.write.parquet(path)
        frame = spark.read.parquet(path)
        texts[name] = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    first, second, third, fourth, fifth = texts.values()
    assert not {i for i, _ in junk} & set(first)
    assert len(set(first) & {i for i, _ in clean}) >= 196
    gone = {i for i, _ in copies + near}
    assert not {i for i in gone & set(first) if {400: i - 400, 500: i - 490}[i // 100 * 100] in first} & set(second)
    assert set(first) - set(second) <= gone
    expected = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in brute_repeats(sorted(second.items()), 200)}
    assert third == {i: t for i, t in expected.items() if t}
    assert not any(passage in t for t in third.values())
    hit = {i for i, _, n, _ in brute_contamination(sorted(third.items()), items, 10) if n}
    assert hit and fourth == {i: t for i, t in third.items() if i not in hit}
    assert fifth == fourth
    library = reference_encoding()
    assert all(r.ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in frame.collect())
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id: r.ids for r in frame.collect()}


def test_stages_of_a_table_with_nulls_and_of_an_empty_one(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = docs([(1, None), (2, ""), (None, "text of a null key"), (3, "twice"), (3, "twice")]).selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    for frame in (odd, odd.where("false")):
        for _, stage in STAGES:
            frame = stage(spark, frame, str(tmp_path))
        assert frame.count() <= 4


def test_rows_of_one_id_or_without_one_stand_for_themselves(spark, docs, rng, tmp_path):
    item, a, b, c, d, e, f = (sentence(rng, 30) for _ in range(7))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (None, d), (None, a), (3, e), (0, e), (3, f), (4, None), (4, "")]
    left = corpus_pipeline.simhash_near_dedup(spark, docs(rows), str(tmp_path))
    found = sorted([(r.doc_id, r.text or "") for r in left.collect()], key=str)  # null and empty are alike, so either may stay
    assert found == sorted([(1, a), (1, b), (None, c), (None, d), (0, e), (3, f), (4, "")], key=str)
    rows = [(1, a), (1, f"{b} {item}"), (None, c), (None, f"{item} {d}"), (2, item), (4, None), (4, "")]
    left = corpus_pipeline.benchmark_decontamination(spark, docs(rows), str(tmp_path))
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted([(1, a), (None, c), (4, None), (4, "")], key=str)


def test_documents_within_two_bits_are_near_copies_whatever_their_shingle_sets(spark, docs, rng, tmp_path):
    chorus, a, b, c, d = sentence(rng, 31), *(sentence(rng, n) for n in (20, 20, 60, 60))
    rows = [(5, f"{chorus} " * 20 + a), (2, f"{chorus} " * 20 + b), (3, c), (None, d), (4, c.upper() + " ")]
    prints = [brute_fingerprint(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[0] ^ prints[2]).bit_count()
    left = corpus_pipeline.simhash_near_dedup(spark, docs(rows), str(tmp_path))
    assert sorted([r.doc_id for r in left.collect()], key=str) == [2, 3, None]


def test_arrow_batches_of_every_stage_are_cut_by_bytes(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "item")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = spark.range(0, 6000, 1, 1).selectExpr("repeat('a', 2000) text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        for _, stage in STAGES:
            spark.conf.unset(setting)
            stage(spark, docs([]), str(tmp_path))
            found = [r.n for r in long.mapInArrow(sizes, "n bigint").collect()]
            assert sum(found) >= 12_000_000 and max(found) <= BATCH_BYTES + 10_000
    finally:
        spark.conf.set(setting, before)


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
