"""Sharding and packing against plain loops."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rinseframe.llm import packing, queries, sharding
from rinseframe.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jump_by_loop(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, shards).tolist() == [jump_by_loop(int(k), shards) for k in keys]


def test_shards_of_all_documents(spark):
    rows = queries.op1_jump_shards(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    places = defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len(places) == 8


def test_shards_of_odd_rows(spark):
    rows = [(None, "a", "x"), (None, None, "y"), (1, "a", "z"), (1, "a", "z")]
    frame = spark.createDataFrame(rows, "id long, text string, SHARD string")
    found = sharding.sharded(frame, "id", 3).collect()
    assert len(found) == 4 and set(found[0].asDict()) == {"id", "text", "shard", "grown_shard", "slot"}
    by_key = defaultdict(set)
    for r in found:
        by_key[r.id].add(r.shard)
    assert all(len(s) == 1 for s in by_key.values())
    assert sharding.sharded(frame.limit(0), "id", 3).collect() == []
    with pytest.raises(ValueError):
        sharding.sharded(frame, "id", 0)


def test_slots_of_one_hot_shard(spark):
    found = sharding.slots(spark.range(1000, numPartitions=7).selectExpr("id", "0 AS shard")).collect()
    assert sorted(r.slot for r in found) == list(range(1000))


def bins_of(runs):
    bins = defaultdict(list)
    for length, start, end, first, per_bin, place in runs:
        for rank in range(start, end):
            index = rank - start
            bins[first + index // per_bin].append((place + index % per_bin * length, length))
    return bins


def best_fit_by_loop(lengths, capacity):
    space = []
    for length in sorted(lengths, reverse=True):
        fitting = [(s, i) for i, s in enumerate(space) if s >= length]
        if fitting:
            space[min(fitting)[1]] -= length
        else:
            space.append(capacity - length)
    return len(space)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_is_best_fit(lengths):
    runs = packing.plan(dict(Counter(lengths)), 50)
    bins = bins_of(runs)
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
    for pieces in bins.values():
        at = 0
        for place, length in sorted(pieces):
            assert place == at
            at += length
        assert at <= 50
    assert len(bins) == best_fit_by_loop(lengths, 50)
    for length in set(lengths):
        ranks = sorted((a, b) for n, a, b, *_ in runs if n == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == lengths.count(length)
        assert all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))


def test_plan_stays_short():
    counts = {n: 10_000_000 // n + n * 37 % 1001 for n in range(1, 1025)}
    assert len(packing.plan(counts, 1024)) < 50_000


def check_packing(frame, texts, capacity=1024):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = frame.collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_document[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for place, length in sorted(pieces):
            assert place == at
            at += length
        assert at <= capacity
    assert set(by_document) == set(texts)
    for doc_id, pieces in by_document.items():
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.length == capacity for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert (len(part) // 4, zlib.crc32(part)) == (r.length, r.ids_crc32)
    total = sum(r.length for r in rows)
    assert len(by_sequence) == best_fit_by_loop([r.length for r in rows], capacity) >= -(-total // capacity)


def test_packing_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(queries.op2_best_fit_packing(spark, SF), texts)


def test_packing_of_odd_rows(spark, tmp_path):
    texts = {1: None, 2: "", 3: "  a\n\n b <|endoftext|> c", 4: "word " * 5000, 5: "日本 ﷽ 😀" * 400, 6: "x" * 3000}
    rows = [(k, v, None, None, None) for k, v in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    check_packing(queries.op2_best_fit_packing(spark, str(tmp_path)), texts)
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op2_best_fit_packing(spark, f"{tmp_path}/none").collect() == []


def test_rows_that_cannot_be_packed(spark):
    rows = [(5, "a", 7), (None, "b", 7), (0, "c", 7), (11, "d", 7)]
    frame = spark.createDataFrame(rows, "length long, name string, OFFSET long")
    found = {r.name: (r.sequence_id, r.offset) for r in packing.pack(frame, "length", 10).collect()}
    assert found == {"a": (0, 0), "b": (None, None), "c": (None, None), "d": (None, None)}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1'\n\t  é日\u0085\x1c 　<|endoftext|>.,-"), max_size=40) | st.text(max_size=30))
def test_ids_are_those_of_the_tokenizer(text):
    own = encoder(*queries.BYTE_BPE.values())
    expected = own.whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == expected
