"""Alignment of two tokenizers against set intersection and plain counting."""

import hashlib
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plain import write
from rinseframe.llm import alignment, bytelevel, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_groups(a_ends, b_ends):
    both = sorted(set(a_ends) & set(b_ends))
    a_index, b_index = {e: i for i, e in enumerate(a_ends)}, {e: i for i, e in enumerate(b_ends)}
    a_last, b_last = [-1] + [a_index[e] for e in both], [-1] + [b_index[e] for e in both]
    return np.diff(a_last).tolist(), np.diff(b_last).tolist()


@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), max_size=60), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_groups(a, b, alike):
    a_ends, b_ends = np.cumsum(a + [1] * alike + a), np.cumsum(b + [1] * alike + a)
    end = max(a_ends[-1] if len(a_ends) else 0, b_ends[-1] if len(b_ends) else 0) + 1
    a_ends, b_ends = np.append(a_ends, end), np.append(b_ends, end)
    assert tuple(x.tolist() for x in alignment.groups(a_ends, b_ends)) == plain_groups(a_ends.tolist(), b_ends.tolist())


@pytest.mark.parametrize("length", [*range(1, 40), 1000])
def test_one_run(length):
    ends = np.arange(1, length + 1) * 3
    assert alignment.groups(ends, ends)[0].tolist() == [1] * length
    assert alignment.groups(np.empty(0), np.empty(0))[0].tolist() == []


def test_links_of_large_groups(monkeypatch):
    rng = np.random.default_rng(1)
    a_sizes, b_sizes = np.array([3, 1, 40, 2]), np.array([2, 1, 50, 5])
    a, b = rng.integers(0, 6, a_sizes.sum()), rng.integers(0, 6, b_sizes.sum())
    row = np.array([0, 0, 1, 1])
    whole = alignment.link_pairs(a, b, a_sizes, b_sizes, row)
    monkeypatch.setattr(alignment, "FEW_LINKS", 4)
    parts = alignment.link_pairs(a, b, a_sizes, b_sizes, row)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    assert whole[1].sum() == (a_sizes * b_sizes).sum()


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(queries.BYTE_BPE["tokenizer_path"])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
        self.byte = bytelevel.byte_of_character()

    def groups(self, text):
        if not text:
            return []
        whole = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False)
        b = self.b.encode(text)
        a_bytes = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a.ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return []
        sizes = plain_groups(np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist())
        groups, i, j = [], 0, 0
        for n, m in zip(*sizes):
            groups.append((a.ids[i : i + n], b[j : j + m]))
            i, j = i + n, j + m
        return groups


def expected(rows):
    plain = Plain()
    found = [plain.groups(text) for _, text in rows]
    docs = Counter(pair for groups in found for pair in {(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), count in docs.items():
        most[x] = max(most[x], count)
    result = []
    for (doc_id, _), groups in zip(rows, found):
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        counts = (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links))
        best = sum(docs[link] == most[link[0]] for link in links)
        result.append((doc_id, *counts, best, sum(docs[link] for link in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(result, key=repr)


def rows_of(frame):
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op12_diagonal_alignment(spark, sf)) == expected(rows)


ODD = [None, "", " ", "  two  blanks ", "a▁b", "▁", "<|endoftext|> and <s></s><unk><0x41>", "\n\n\t\r\n", "日本語のテキスト", "🙂🙃 é é \u0000x",
       "=" * 3000, "ab" * 2000, "ÿþ" * 300, "word " * 4000, "́́́", "İ ﬁ ½ Ⅷ"]


def test_odd_texts(spark, tmp_path):
    rng = Random(9)
    alphabet = "ab  \n▁é日🙂\t=-1.ΣΏ"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(200)]
    rows = [(None if i % 40 == 0 else i, t) for i, t in enumerate(texts)] + [(3, "again a row"), (3, "again a row")]
    write(spark, [(i, t, "x", 1) for i, t in rows], tmp_path, "doc_id long, text string, N_A string, pairs int", "documents")
    assert rows_of(queries.op12_diagonal_alignment(spark, str(tmp_path))) == expected(rows)


def test_small_groups_and_batches(spark, monkeypatch):
    rng = Random(4)
    words = ["alpha", "beta", "gamma", "naïve", "tokenization", "über", "x=1", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = alignment.aligned(frame, "text", model_path=queries.PIECE_MODEL, **queries.BYTE_BPE).cache()
    one = alignment.scored(found).orderBy("doc_id").select("doc_id", "n_best", "count_sum").collect()
    other = found.selectExpr("*", "doc_id % 7 AS g").drop("pair_group").withColumnRenamed("g", "pair_group")
    two = alignment.scored(other).orderBy("doc_id").select("doc_id", "n_best", "count_sum").collect()
    assert one == two and [r[0] for r in one] == list(range(60))
    lengths = np.array([5, 1 << 21, 0, 0, 7])
    assert list(alignment.slices(lengths)) == [(0, 1), (1, 2), (2, 5)]


def test_empty_table(spark, tmp_path):
    write(spark, [], tmp_path, "doc_id long, text string", "documents")
    assert rows_of(queries.op12_diagonal_alignment(spark, str(tmp_path))) == []
