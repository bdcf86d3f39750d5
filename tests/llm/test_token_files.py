"""Packed token ids against plain loops and the tokenizers library."""

import zlib
from collections import Counter
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plain import write
from rinseframe.llm import queries, token_files

TOKENIZER = Tokenizer.from_file(queries.WORD_BPE)


def expected(rows):
    """doc_id, start, n_tokens, crc in ascending order of ids, null ids first."""
    start, result = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]
        result.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return result


def rows_of(frame):
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in frame.collect()]
    return sorted(rows, key=lambda r: r[1])


@pytest.mark.parametrize("width", range(1, 33))
def test_bits(width):
    rng = np.random.default_rng(width)
    for count in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << width, count, dtype=np.uint64)
        data = token_files.pack_bits(ids, width)
        assert len(data) == -(-count // 64) * 8 * width
        assert token_files.unpack_bits(data, width, count).tolist() == ids.tolist()
        bits = "".join(f"{b:08b}"[::-1] for b in data)
        assert all(int(bits[i * width : (i + 1) * width][::-1], 2) == ids[i] for i in range(min(count, 70)))


def test_width():
    assert [token_files.width_of(v) for v in (1, 2, 3, 32_000, 32_769, 49_408, 50_257, 1 << 16, 1 << 32)] == [1, 1, 2, 15, 16, 16, 16, 16, 32]


def test_random_access(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(token_files, "STRIP_IDS", 3 * token_files.BLOCK_IDS)
    documents = [rng.integers(0, 50_000, n).astype(np.uint32) for n in [0, 1, 64, 8192, 50_000, 3, 0, 24_577, 100_000]]
    sink = pa.BufferOutputStream()

    class Kept:
        write = sink.write
        close = staticmethod(lambda: None)

    writer = token_files.Writer(Kept, 17)
    for i, ids in enumerate(documents):
        writer.add(None if i == 5 else i * 10, ids)
    writer.close()
    reader = token_files.Reader(pa.BufferReader(sink.getvalue()))
    whole = np.concatenate(documents)
    assert reader.n_ids == len(whole) and len(reader.offsets) == -(-len(whole) // token_files.BLOCK_IDS) + 1
    assert [reader.document(i).tolist() for i in range(len(documents))] == [d.tolist() for d in documents]
    assert reader.known.tolist() == [1, 1, 1, 1, 1, 0, 1, 1, 1]
    for start, length in [(0, 0), (0, 1), (8191, 2), (12_345, 40_000), (len(whole) - 1, 1)]:
        assert (reader.ids(start, length) == whole[start : start + length]).all()
    with pytest.raises(IndexError):
        reader.ids(len(whole), 1)
    with pytest.raises(ValueError):
        writer.add(1, np.array([1 << 17], dtype=np.uint32))
    with pytest.raises(ValueError):
        token_files.Reader(pa.BufferReader(sink.getvalue()[:-1]))


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op11_bit_packed_ids(spark, sf)) == expected(rows)


ODD = ["", None, "  ", "It's 12 o'clock!", "a<|endoftext|>b <|startoftext|>", "é ́x", "ÀÉ\tß\nΣΑΣ", " x y　z", "日本語 text",
       "\x1cA\x1d", "don't 'S 'll", "x" * 5000, "🙂" * 50, "word " * 3000, "İstanbul ǅ"]


def test_odd_texts(spark, tmp_path):
    rng = Random(5)
    alphabet = "aB'’s 1\n\t é́<|>ΣΣ　\x1f.,日🙂"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(None if i % 50 == 0 else i * 7919 % 1000, t) for i, t in enumerate(texts)]
    rows = list({r[0]: r for r in rows if r[0] is not None}.values()) + [(None, "no id")]
    write(spark, [(i, t, "x", 1) for i, t in rows], tmp_path, "doc_id long, text string, IDS string, start int", "documents")
    assert rows_of(queries.op11_bit_packed_ids(spark, str(tmp_path))) == expected(rows)


def test_repeated_rows_and_many_files(spark, tmp_path):
    rng = Random(6)
    rows = [(7 if i % 3 else rng.randrange(100), [rng.randrange(30_000) for _ in range(rng.randrange(1, 400))]) for i in range(300)]
    tokens = spark.createDataFrame([(k, np.array(v, dtype="<u2").tobytes()) for k, v in rows], "key long, ids binary").repartition(5)
    path = str(tmp_path / "packed")
    files = token_files.write_tokens(tokens, path, "key", "ids", 30_000, file_ids=5000, file_docs=40, part_bytes=8000).collect()
    assert len(files) > 10 and max(f.part for f in files) > 8 and max(f.n_ids for f in files) < 6000
    assert max(Counter(f.part for f in files).values()) < 6  # the key of two thirds of all rows is dealt to many tasks
    assert sum(f.n_docs for f in files) == 300
    found = token_files.read_tokens(spark, path, "key").orderBy("start").collect()
    assert sorted((r.key, bytes(r.ids)) for r in found) == sorted((k, np.array(v, dtype="<u4").tobytes()) for k, v in rows)
    assert [r.key for r in found] == sorted(k for k, _ in rows)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    whole = b"".join(bytes(r.ids) for r in found)
    spans = [(i, rng.randrange(len(whole) // 4), rng.choice([0, 1, 50, 12_000])) for i in range(40)]
    asked = spark.createDataFrame(spans, "span long, start long, length long")
    pieces = {}
    for r in token_files.read_spans(spark, path, asked).collect():
        pieces.setdefault(r.span, []).append((r.at, bytes(r.ids)))
    for span, start, length in spans:
        assert b"".join(p for _, p in sorted(pieces.get(span, []))) == whole[4 * start : 4 * (start + length)]


def test_empty_table(spark, tmp_path):
    write(spark, [], tmp_path, "doc_id long, text string", "documents")
    assert queries.op11_bit_packed_ids(spark, str(tmp_path)).collect() == []
