"""Alignment of two tokenizers' tokens over the same text, by diagonal run skipping.

Both token sequences cover the same bytes, so each is an ascending array of end offsets, and
the places where both end cut the text into groups. While the tokenizers agree, equal ends
stand at indexes that differ by a constant shift: probes of 1, 2, 4, ... tokens compare the
two arrays along that diagonal and jump over the whole one-to-one stretch. Where a probe
fails it is halved down to the first difference, the irregular group there is walked to
its next common end, and the shift follows from its sizes. All texts of a batch are aligned
as one sequence, since texts end in both arrays.

``aligned`` gives ids and group sizes of each row. ``pair_counts`` and ``scored`` tell how many
documents link each pair of ids. Documents are taken together in groups of bounded size; a
group sends each of its pairs once, however often it occurs, and gets the count back, so
the pairs of every text in the corpus add one row per group and no document's pair list is
expanded into rows.

Defined results: texts that are null, empty, or not reproduced byte for byte by both
tokenizers have no tokens, groups or links; repeated rows are documents of their own; an
empty table stays empty; input columns named like an added column are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm import pieces
from rinseframe.llm.bytelevel import byte_of_character
from rinseframe.llm.frames import Scratch, fresh, without
from rinseframe.llm.tokens import BEFORE_WORD, DOUBLE_SPACE, USUAL, Encoder

#: ids of both vocabularies are below 2^20, so a pair and a row of a batch fit into 64 bits
ID_BITS = 20
PAIR, PAIR_BYTES = (1 << 2 * ID_BITS) - 1, 5
#: texts that words alone do not make: neighbouring white space, also at an end, or a space mark
UNEVEN = re.compile(rf"\s\s|^\s|\s$|{pieces.SPACE}")
#: words, and chunks of each tokenizer, remembered by a Python worker: about 60 MB
REMEMBERED = 250_000
#: text bytes aligned at once, rows at once, bytes of pair lists of one group of documents
BATCH_BYTES, BATCH_ROWS, GROUP_BYTES = 1 << 18, 1 << 14, 8 << 20
#: groups with more links than this are counted by distinct ids instead of link by link
FEW_LINKS = 1024
LISTS = {name: "array<int>" for name in ("a_ids", "b_ids", "a_sizes", "b_sizes")}
COUNTS = {name: "long" for name in ("n_a", "n_b", "n_groups", "n_links")}
PAIRS = {"pair_group": "long", "pairs": "binary", "pair_links": "binary"}
#: what a slice of texts gives, see ``align_texts``
Found = dict[str, np.ndarray]


# ---- tokens with their bytes


class Chunks:
    """Ids of whole texts from ids of their chunks; chunks met before are looked up."""

    def __init__(self, kind: str):
        self.kind = kind
        self.known: dict[str, bytes] = {"": b""}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.chunks(t) for t in texts]
        new = set().union(*split) - self.known.keys()
        self.known.update(self.encode(list(new)))
        found = [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), dtype=self.kind) for chunks in split]
        for chunk in new:
            if len(self.known) <= REMEMBERED and len(chunk) <= 64:
                continue
            del self.known[chunk]
        return found

    def chunks(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError


class ByteChunks(Chunks):
    """Byte-level ids; a special token's string is text like any other."""

    def __init__(self, *paths: str):
        super().__init__("<u4")
        self.own = Encoder(*paths)
        self.own.special = []
        self.own.whole.encode_special_tokens = True

    def chunks(self, text: str) -> list[str]:
        if DOUBLE_SPACE.search(text):
            return BEFORE_WORD.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]]

    def encode(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        fast, whole = self.own.fast, self.own.whole
        for chunk in chunks:
            if fast and USUAL.fullmatch(chunk):
                ids = fast.encode_ordinary(chunk)
            else:
                ids = whole.encode(chunk, add_special_tokens=False).ids
            yield chunk, array("I", ids).tobytes()


class PieceChunks(Chunks):
    """Ids of a piece model, chunks cut where nothing can merge."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__("<i4")
        self.model = pieces.model(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def chunks(self, text: str) -> list[str]:
        return self.model.words(text)

    def encode(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        # the library puts one space mark before a text, so it takes words that begin with just one
        words = [c for c in chunks if c[:1] == pieces.SPACE and len(c) > 1 and pieces.SPACE not in c[1:]]
        yield from zip(words, (array("i", ids).tobytes() for ids in self.library.encode([w[1:] for w in words], num_threads=1)))
        others = list(set(chunks).difference(words))
        yield from zip(others, self.model.merged(others) if others else ())


class Surfaces:
    """Bytes of every id, as one array with offsets."""

    def __init__(self, of_id: list[bytes]):
        if len(of_id) > 1 << ID_BITS:
            raise ValueError("the vocabulary is too large")
        self.size = np.array([len(s) for s in of_id], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(of_id), dtype=np.uint8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of ids."""
        size = self.size[ids]
        begin = np.cumsum(size) - size
        return self.data[np.arange(size.sum()) + np.repeat(self.begin[ids] - begin, size)]


class Pair:
    """Both tokenizers and the bytes of their ids.

    What stands between two blanks is a chunk of both, so texts of single blanks take the ids of
    both from one look-up for each word.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str, model_path: str):
        self.a, self.b = ByteChunks(tokenizer_path, ranks_path, pattern), PieceChunks(model_path)
        byte = byte_of_character()
        tokenizer = self.a.own.whole
        surface = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            known = all(c in byte for c in token)
            surface[i] = bytes(byte[c] for c in token) if known else token.encode()
        self.a_bytes, self.b_bytes = Surfaces(surface), Surfaces(self.b.model.surface)
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides of each text."""
        a: list = [None] * len(texts)
        b: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and not UNEVEN.search(t)]
        split = [texts[i].split(" ") for i in plain]
        found = [list(map(self.known.get, words)) for words in split]
        new = {w for words, pairs in zip(split, found) if None in pairs for w, pair in zip(words, pairs) if pair is None}
        fresh_pairs = self.pairs(list(new))
        for i, words, pairs in zip(plain, split, found):
            if None in pairs:
                pairs = [fresh_pairs[w] if pair is None else pair for w, pair in zip(words, pairs)]
            a[i] = np.frombuffer(b"".join([pair[0] for pair in pairs]), dtype=self.a.kind)
            b[i] = np.frombuffer(b"".join([pair[1] for pair in pairs]), dtype=self.b.kind)
        room = REMEMBERED - len(self.known)
        if room > 0:
            self.known.update(pair for pair in list(fresh_pairs.items())[:room] if len(pair[0]) <= 64)
        others = [i for i, ids in enumerate(a) if ids is None]
        for i, x, y in zip(
            others, self.a.encode_all([" " + texts[i] if texts[i] else "" for i in others]), self.b.encode_all([texts[i] for i in others])
        ):
            a[i], b[i] = x, y
        return a, b

    def pairs(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        of_a = (blob for _, blob in self.a.encode([" " + w for w in words]))
        of_b = (array("i", ids).tobytes() for ids in self.b.library.encode(words, num_threads=1))
        return {w: (x, y) for w, x, y in zip(words, of_a, of_b)}


@lru_cache(maxsize=1)
def pair_of(*paths: str) -> Pair:
    return Pair(*paths)


def spelled_groups(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, decimals: Surfaces) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids of all groups as ``a1,a2|b1;a3|b2,b3;`` and how many bytes each group takes.

    ``decimals`` holds the decimals of n ids with a comma, then with a bar, then with a semicolon after them.
    """
    ids = len(decimals.size) // 3
    group = np.arange(len(a_sizes))
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    marked_a, marked_b = a.astype(np.int64), b.astype(np.int64)
    marked_a[a_ends - 1] += ids
    marked_b[b_ends - 1] += 2 * ids
    both = np.empty(len(a) + len(b), dtype=np.int64)
    both[np.arange(len(a)) + np.repeat(b_ends - b_sizes, a_sizes)] = marked_a
    both[np.arange(len(b)) + np.repeat(a_ends, b_sizes)] = marked_b
    owner = np.repeat(group, a_sizes + b_sizes)
    return decimals.text(both), np.bincount(owner, decimals.size[both], len(group)).astype(np.int64)


@lru_cache(maxsize=1)
def decimals_of(ids: int) -> Surfaces:
    return Surfaces([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(ids)])


# ---- groups


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each side in each group of two ascending arrays of ends, whose last ends are equal."""
    n = len(a_ends)
    # different marks after the last ends, so no probe over them succeeds
    a, b = np.append(a_ends, -1).astype("<i8").tobytes(), np.append(b_ends, -2).astype("<i8").tobytes()
    a_at, b_at = a_ends.tolist(), b_ends.tolist()
    runs, a_sizes, b_sizes = [], [], []
    i = shift = 0
    while i < n:
        p, q, step = 8 * i, 8 * (i + shift), 8
        while a[p : p + step] == b[q : q + step]:
            p, q, step = p + step, q + step, 2 * step
        step //= 2
        while step >= 8:
            if a[p : p + step] == b[q : q + step]:
                p, q = p + step, q + step
            step //= 2
        runs.append(p // 8 - i)
        i = p // 8
        if i == n:
            break
        x, y = i, i + shift
        while a_at[x] != b_at[y]:
            if a_at[x] < b_at[y]:
                x += 1
            else:
                y += 1
        a_sizes.append(x - i + 1)
        b_sizes.append(y - i - shift + 1)
        i, shift = x + 1, y - x
    irregular = np.cumsum(np.array(runs, dtype=np.int64) + 1)[: len(a_sizes)] - 1
    sizes = np.ones((2, int(sum(runs)) + len(a_sizes)), dtype=np.int64)
    sizes[0, irregular], sizes[1, irregular] = a_sizes, b_sizes
    return sizes[0], sizes[1]


def link_pairs(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, pair) keys, ascending, with their links; ``row`` is that of each group."""
    a_from, b_from = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    links = a_sizes * b_sizes
    few = np.flatnonzero(links <= FEW_LINKS)
    count = links[few]
    of = np.repeat(few, count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    a_here, b_here = a[a_from[of] + place // b_sizes[of]], b[b_from[of] + place % b_sizes[of]]
    keys, weights = [row[of] << 2 * ID_BITS | a_here << ID_BITS | b_here], [np.ones(len(of), dtype=np.int64)]
    for g in np.flatnonzero(links > FEW_LINKS):
        a_ids, a_times = np.unique(a[a_from[g] : a_from[g] + a_sizes[g]], return_counts=True)
        b_ids, b_times = np.unique(b[b_from[g] : b_from[g] + b_sizes[g]], return_counts=True)
        keys.append((row[g] << 2 * ID_BITS | a_ids[:, None] << ID_BITS | b_ids).ravel())
        weights.append(np.outer(a_times, b_times).ravel())
    return summed(np.concatenate(keys), np.concatenate(weights))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begins], np.add.reduceat(weights[order], begins)


def flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values one after the other as int64, number of each part)."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, dtype=np.int64), sizes


def reproduced(ids: np.ndarray, sizes: np.ndarray, surfaces: Surfaces, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which rows' ids spell their text."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.bincount(row, surfaces.size[ids], len(sizes)).astype(np.int64) == lengths
    kept = good[row]
    if not good.all():
        text = text[np.repeat(good, lengths)]
    wrong = np.flatnonzero(surfaces.text(ids[kept]) != text)
    if len(wrong):
        ends = np.cumsum(np.where(good, lengths, 0))
        good[np.searchsorted(ends, wrong, side="right")] = False
    return good


def align_texts(texts: list[str | None], pair: Pair) -> Found:
    """Of some texts, one after the other: ids, group sizes, distinct pairs with their links, and the numbers of each."""
    spaced = [" " + t if t else "" for t in texts]
    raw = [t.encode("utf-8", "surrogatepass") for t in spaced]
    text, lengths = np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(r) for r in raw], dtype=np.int64)
    (a, a_count), (b, b_count) = map(flat, pair.encode([t or "" for t in texts]))
    good = reproduced(a, a_count, pair.a_bytes, text, lengths) & reproduced(b, b_count, pair.b_bytes, text, lengths) & (lengths > 0)
    a, b = a[np.repeat(good, a_count)], b[np.repeat(good, b_count)]
    a_count, b_count = np.where(good, a_count, 0), np.where(good, b_count, 0)
    ends = np.cumsum(pair.a_bytes.size[a])
    a_sizes, b_sizes = groups(ends, np.cumsum(pair.b_bytes.size[b]))
    # each group belongs to the text in which its last token stands
    row = np.searchsorted(np.cumsum(a_count), np.cumsum(a_sizes) - 1, side="right")
    keys, links = link_pairs(a, b, a_sizes, b_sizes, row)
    key_row = keys >> 2 * ID_BITS
    return {
        "a": a, "b": b, "a_sizes": a_sizes, "b_sizes": b_sizes, "pairs": keys & PAIR, "links": links,
        "a_count": a_count, "b_count": b_count,
        "group_count": np.bincount(row, minlength=len(texts)),
        "pair_count": np.bincount(key_row, minlength=len(texts)),
        "link_count": np.bincount(key_row, links, len(texts)).astype(np.int64),
    }


# ---- tables


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def blob_column(values: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts) * np.dtype(kind).itemsize]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(kind))])


def slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``BATCH_BYTES`` of text and at most ``BATCH_ROWS``, at least one row each."""
    total, first = np.cumsum(lengths), 0
    while first < len(lengths):
        before = int(total[first - 1]) if first else 0
        end = min(max(first + 1, int(np.searchsorted(total, before + BATCH_BYTES, side="right"))), first + BATCH_ROWS)
        yield first, end
        first = end


def aligned(
    df: DataFrame,
    text: str,
    tokenizer_path: str,
    ranks_path: str | None,
    pattern: str,
    model_path: str,
    lists: bool = True,
    derived: dict[str, tuple[str, Callable[[Found], list]]] | None = None,
) -> DataFrame:
    """Each row's alignment: the other columns, ids and group sizes of both sides, counts, and its pairs.

    ``pairs`` and ``pair_links`` are blobs: distinct pairs, ascending, as ``a << 20 | b`` in steps
    from one to the next (``steps``), and how many links each has in the text (uint32).
    ``pair_group`` tells the group of documents. ``derived`` names further columns, their types and
    functions of what ``align_texts`` finds, which give a value for each text; without ``lists``
    ids and sizes stay in the tasks.
    """
    derived = derived or {}
    kinds = {**(LISTS if lists else {}), **COUNTS, **PAIRS, **{name: kind for name, (kind, _) in derived.items()}}
    df = without(df, *[c for c in kinds if c != text.lower()])
    kept = [f for f in df.schema.fields if f.name.lower() != text.lower()]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias(fresh(df, "text_to_align")))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` {k}" for n, k in kinds.items()])
    width, paths, names = len(kept), (tokenizer_path, ranks_path, pattern, model_path), [*[f.name for f in kept], *kinds]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, group, held = pair_of(*paths), TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            lengths = pc.binary_length(whole.column(width)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end in slices(lengths):
                batch = whole.slice(first, end - first)
                if held > GROUP_BYTES:
                    group, held = group + 1, 0
                found = align_texts(batch.column(width).to_pylist(), pair)
                held += 9 * len(found["pairs"])
                columns = [
                    *([list_column(found[c], found[n]) for c, n in LIST_OF] if lists else []),
                    *[pa.array(found[c].astype(np.int64)) for c in ("a_count", "b_count", "group_count", "link_count")],
                    pa.array(np.full(end - first, group)),
                    steps(found["pairs"], found["pair_count"]), blob_column(found["links"], found["pair_count"], "<u4"),
                    *[pa.array(function(found)) for _, function in derived.values()],
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], names=names)

    return source.mapInArrow(align, fields)


LIST_OF = [("a", "a_count"), ("b", "b_count"), ("a_sizes", "group_count"), ("b_sizes", "group_count")]


def steps(pairs: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Ascending pairs of each row as the differences of neighbours, in five bytes each."""
    change = np.diff(pairs, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    change[first] = pairs[first]
    data = np.ascontiguousarray(change.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES])
    offsets = np.concatenate([[0], np.cumsum(counts) * PAIR_BYTES]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def pairs_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of all rows, number in each)."""
    blobs = column.to_pylist()
    counts = np.array([len(x) // PAIR_BYTES for x in blobs], dtype=np.int64)
    wide = np.zeros((int(counts.sum()), 8), dtype=np.uint8)
    wide[:, :PAIR_BYTES] = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, PAIR_BYTES)
    total = np.cumsum(wide.view("<i8").ravel())
    begin = np.cumsum(counts) - counts
    before = np.concatenate([[0], total])[begin]
    return total - np.repeat(before, counts), counts


def group_pairs(found: DataFrame) -> DataFrame:
    """(pair_group, pair, docs): each pair of a group of documents, usually once, with the documents that link it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, held = None, [], 0

        def rows() -> pa.RecordBatch:
            pairs, docs = np.unique(np.concatenate(waiting), return_counts=True)
            columns = [pa.array(np.full(len(pairs), group)), pa.array(pairs), pa.array(docs.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["pair_group", "pair", "docs"])

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, end in runs(ids):
                if waiting and (ids[first] != group or held > GROUP_BYTES):
                    yield rows()
                    waiting, held = [], 0
                group = int(ids[first])
                values, _ = pairs_of(batch.column(1).slice(first, end - first))
                waiting.append(values)
                held += values.nbytes
        if waiting:
            yield rows()

    return found.select("pair_group", "pairs").mapInArrow(count, "pair_group long, pair long, docs long")


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else []
    yield from zip(begins, np.append(begins[1:], len(values)) if len(values) else [])


def pair_counts(by_group: DataFrame) -> DataFrame:
    """(pair, count, best): documents that link each pair, and whether no other pair of its A id has more."""
    counts = by_group.groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", ID_BITS))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(found: DataFrame) -> DataFrame:
    """Replace the pairs of ``aligned`` rows by ``n_best`` (links whose pair is the best of its A id) and
    ``count_sum`` (the sum over links of how many documents link their pair).

    The rows are stored once, so leave out columns that are not needed.
    """
    scratch = Scratch(found.sparkSession)
    found = scratch.stored(without(found, "n_best", "count_sum"), "aligned")
    by_group = scratch.stored(group_pairs(found), "pairs")
    counts = scratch.stored(pair_counts(by_group), "counts")
    answers = by_group.select("pair_group", "pair").join(counts, "pair").select("pair_group", "pair", "count", "best")
    kept = [f for f in found.schema.fields if f.name not in ("pair_group", "pairs", "pair_links")]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_best long", "count_sum long"])

    def score(documents: pa.Table, known: pa.Table) -> pa.Table:
        pair, at = np.unique(known.column("pair").to_numpy(), return_index=True)
        count, best = known.column("count").to_numpy()[at], known.column("best").to_numpy()[at]
        pairs, sizes = pairs_of(documents.column("pairs"))
        links = np.frombuffer(b"".join(documents.column("pair_links").to_pylist()), dtype="<u4").astype(np.int64)
        place, row = np.searchsorted(pair, pairs), np.repeat(np.arange(len(sizes)), sizes)
        sums, bests = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        if len(pairs):
            np.add.at(sums, row, links * count[place])
            np.add.at(bests, row, links * best[place])
        result = documents.select([f.name for f in kept])
        return result.append_column("n_best", pa.array(bests)).append_column("count_sum", pa.array(sums))

    together = found.groupBy("pair_group").cogroup(answers.groupBy("pair_group"))
    result = scratch.stored(together.applyInArrow(score, fields), "scored")
    scratch.drop(found, by_group, counts)
    return result
