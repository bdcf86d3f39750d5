"""The corpus pipeline against plain Python, stage by stage."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from compare import connect
from plain import DOCUMENTS, near_groups, without_repeats, words
from rinseframe.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = {r.doc_id: r for r in docs.collect()}
    kept = connect(SF).sql(f"select doc_id from ({ORACLE['op7_adaptive_quality']}) where kept").fetchall()
    expected = {d: expected[d] for (d,) in kept}
    current = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        found = stage(spark, current, SF)
        assert found.columns == docs.columns
        found.write.parquet(f"{tmp_path}/{number}")
        current = spark.read.parquet(f"{tmp_path}/{number}")
        if name == "near dedup":
            groups = near_groups([(d, r.text) for d, r in expected.items()], 5, 80)
            expected = {d: r for d, r in expected.items() if groups[d][1] == d}
        if name == "substring dedup":
            removed = without_repeats([(d, r.text) for d, r in expected.items()])
            found = {r.doc_id: r for r in current.collect()}
            assert {d: len(words(r.text)) for d, r in found.items()} == {d: n - gone for d, (n, gone, _) in removed.items()}
            assert all(r.n_chars == len(r.text) for r in found.values())
            assert all(r.text == expected[d].text.strip() or removed[d][1] or words(r.text) == words(expected[d].text) for d, r in found.items())
        else:
            assert rows_of(current) == sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in expected.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.offset + r.length <= 1024
    texts = {r.doc_id: r.text for r in current.collect()}
    assert set(pieces) == set(texts)
    for doc_id, parts in pieces.items():
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(parts, key=lambda p: p.piece)])
        assert ids.tolist() == [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 2]


def test_pipeline_of_odd_rows(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (2, None, None, None, None), (None, text + " x", "en", "s", 1)]
    rows += [(None, text.replace("w", "v"), "en", "s", 1)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, None}
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_near_dedup_counts_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    third = " ".join(f"u{i}" for i in range(80))
    rows = [(7, text, "en", "a", 1), (3, text, "en", "b", 2), (3, text, "en", "c", 3), (3, text + " x", "en", "d", 4), (None, text, None, "e", 5)]
    rows += [(None, other, None, "f", 6), (None, other, None, "g", 7), (None, other + " x", None, "h", 8), (None, third, None, None, 9)]
    rows += [(9, third + " y", "fr", "i", 10), (None, third, None, None, 9)]
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCUMENTS).coalesce(1), SF)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.n_chars for r in found.collect()) == [2, 6, 10]
    assert corpus_pipeline.near_dedup(spark, found.limit(0), SF).collect() == []


def test_near_dedup_links_rows_without_id(spark):
    """Rows without id at a similarity near 0.9 to rows with ids: one row of each pair stays, the one with id."""
    rng, rows = random.Random(11), []
    for i in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        copy = [*base[:-6], *(f"x{i}_{j}" for j in range(6))]
        rows += [(i, " ".join(base), "en", "s", i), (None, " ".join(copy), "en", "s", 100 + i)]
    rng.shuffle(rows)
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCUMENTS), SF)
    assert sorted(r.n_chars for r in found.collect()) == list(range(40))


def test_pipeline_packs_repeated_rows_once(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, None, None, None)] * 3 + [(None, text.replace("w", "v"), "en", "s", 1)] * 3
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").collect()) == ["1", "None"]
