"""Substring dedup and near-duplicates against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plain import documents, near_groups, words, without_repeats, write
from rinseframe.llm import components, fingerprints, near, queries, substrings
from rinseframe.llm.frames import Scratch

SF = "/root/testdata/sf0.001"


def table_texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aAbé \t\n\x0b\x1c"), max_size=20), max_size=5))
def test_words_and_their_fingerprints(texts):
    column = pa.array(texts, pa.string())
    prints, firsts = fingerprints.batch_words(column)
    expected = [words(t) for t in texts]
    assert np.diff(firsts).tolist() == [len(w) for w in expected]
    by_word = dict(zip([w for ws in expected for w in ws], prints.tolist()))
    assert [by_word[w] for ws in expected for w in ws] == prints.tolist()
    assert len(set(by_word.values())) == len(by_word)


def test_fingerprints_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "be", "gamma" * 30], k=200))
    one, _ = fingerprints.batch_words(pa.array([text]))
    again, _ = fingerprints.batch_words(pa.array(["x", text, None]))
    assert one.tolist() == again[1:].tolist()
    long_word = "w" * (3 * fingerprints.BLOCK + 5)
    found, _ = fingerprints.batch_words(pa.array([f"{long_word} b {long_word}", long_word + "w"]))
    assert found[0] == found[2] != found[3] and len(found) == 4


def test_cover_aligns_any_two_places():
    cover = set(substrings.COVER)
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in cover and (j + d) % 7 in cover for d in range(7))


def check_repeats(frame, texts):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()}
    assert found == without_repeats(texts)


def test_repeats_of_all_documents(spark):
    check_repeats(queries.op3_substring_dedup(spark, SF), table_texts(spark))


@pytest.mark.parametrize("groups", [1 << 8, 1 << 30])
def test_repeats_in_small_vocabularies(spark, tmp_path, monkeypatch, groups):
    monkeypatch.setattr(substrings, "GROUP_BYTES", groups)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 1 << 10)
    rng = random.Random(3)
    common = [" ".join(rng.choices("abcdef", k=rng.randint(10, 40))) for _ in range(6)]
    texts = [(0, None), (1, ""), (2, " \n "), (3, "a " * 5000), (4, "a " * 30), (5, "x " * 12), (6, "x " * 12)]
    for i in range(7, 90):
        parts = [rng.choice(common) if rng.random() < 0.4 else " ".join(rng.choices("abcdefgh", k=rng.randint(1, 20))) for _ in range(4)]
        texts.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rng.shuffle(texts)
    write(spark, documents(texts), tmp_path)
    check_repeats(queries.op3_substring_dedup(spark, str(tmp_path)), texts)


def test_repeats_with_a_third_of_equal_rows(spark, tmp_path, monkeypatch):
    """Equal rows, and rows without id with equal text, are dealt to groups of bounded size; one long text is a group."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", 1 << 12)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 1 << 12)
    rng = random.Random(4)
    copy = " ".join(f"c{i}" for i in range(40))
    texts = [(i, " ".join(rng.choices("abcdefghijkl", k=60))) for i in range(10, 110)]
    texts += [(500, " ".join(rng.choices("abcdefghijkl", k=20_000)))]
    rows = texts + [(None, copy)] * 50 + [(200, copy)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    groups = substrings.dealt(frame, "text", "row", "part", 1 << 12).groupBy("part").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows"))
    assert all(r.n < (1 << 12) + 200 or r.n >= 40_000 for r in groups.collect()) and groups.count() > 5
    found = substrings.drop_repeats(frame).collect()
    assert sorted((r.n_words, r.n_removed) for r in found if r.doc_id is None) == [(40, 40)] * 50
    assert [(r.n_words, r.n_removed) for r in found if r.doc_id == 200] == [(40, 0)]
    expected = without_repeats(texts)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in found if r.doc_id not in (None, 200)} == {d: v[:2] for d, v in expected.items()}


def test_repeats_of_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(None, passage, 1), (None, passage, 2), (5, passage, 3), (5, passage, 4), (7, passage + " tail", 5), (7, None, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, N_WORDS int")
    found = substrings.drop_repeats(frame)
    assert found.columns == ["doc_id", "text", "n_words", "n_removed"]
    rows = sorted((r.doc_id or 99, r.n_words, r.n_removed, r.text) for r in found.collect())
    assert rows == [(5, 20, 0, passage)] * 2 + [(7, 0, 0, ""), (7, 21, 20, "tail")] + [(99, 20, 20, "")] * 2
    assert substrings.drop_repeats(frame.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 300), (7, 7)]
    rng.shuffle(edges)
    stars = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    expected = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {300: 200}
    assert {r.node: r.root for r in stars} == expected and len(stars) == len(expected)
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []


def check_near(frame, texts, k=3, percent=85):
    rows = frame.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_groups(texts, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_all_documents(spark):
    check_near(queries.op9_tensored_minhash(spark, SF), table_texts(spark))


def near_texts(seed):
    """Families whose members are mostly near the limit, chains, and short texts."""
    rng = random.Random(seed)
    texts = [None, "", " ", "one", "One", "one two", "ONE  two", "one two three", "one two three four"]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(20, 120))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(500)}"
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_at_the_limit(spark, tmp_path):
    texts = near_texts(1)
    write(spark, documents(texts), tmp_path)
    check_near(queries.op9_tensored_minhash(spark, str(tmp_path)), texts)


def template_texts(count, own, seed, words=150):
    """Documents that have all but ``own`` words in common, at the same places, and near copies of a few."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(words - own)]
    texts = []
    for i in range(count):
        text = common + [f"d{i}_{j}" for j in range(own)]
        texts.append(text)
        if i % 20 == 0:
            texts.append([*text[:-1], f"e{i}"])
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("crowded", [4, 10_000])
def test_documents_of_one_template(spark, tmp_path, monkeypatch, crowded):
    monkeypatch.setattr(near, "CROWDED", crowded)
    texts = template_texts(80, 30, 1) + [(1000 + i, t) for i, t in near_texts(2)[:60]]
    write(spark, documents(texts), tmp_path)
    check_near(queries.op9_tensored_minhash(spark, str(tmp_path)), texts)


def test_template_members_are_not_paired(spark):
    """400 documents at a similarity of 0.65: the prefixes pair near copies alone."""
    texts = template_texts(400, 31, 2)
    docs = spark.createDataFrame(texts, "id long, text string")
    sets = near.sets_of(docs, 3).select(F.col("id").alias("node"), "n", "shingles")
    sketched = near.sketches(docs.select("id", "text", F.lit(0).cast("long").alias("h")), 3, 85)
    bounds = sketched.select(F.col("id").alias("node"), "n", "odd")
    crowd = sets.select("node", F.col("node").alias("root"))
    under = near.prefixes(crowd, sets.select("node", "shingles"), 85).cache()
    alone = spark.createDataFrame([], "node long, root long")
    assert near.across_roots(under, alone, bounds, 85).distinct().count() == 20
    assert near.centered(under, crowd).count() == 20


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1), (4, text, 2), (4, text, 2), (2, text + " more", 3), (9, None, 4), (9, "other words here and there", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, KEPT int")
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near.near_duplicates(frame, k=3, percent=85).collect())
    assert found == [(-1, 28, -1, True), (2, 29, 2, True), (4, 28, 2, False), (4, 28, 2, False), (9, 0, 9, True), (9, 3, 9, True)]
    assert near.near_duplicates(frame.limit(0)).collect() == []
    assert near.one_of_each(frame.select("doc_id", "text")).where("doc_id = 4").count() == 0
