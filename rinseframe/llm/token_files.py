"""Token ids in files of fixed-width bits, each id in the fewest bits that hold the vocabulary.

A file, little-endian throughout:

* blocks of ``BLOCK_IDS`` ids, id i of a block at bit i * width; the last block is filled
  up with zeros to a multiple of 64 ids;
* the byte offset of each block and the end of the last one (uint64);
* the documents: keys (int64), whether the key is there (uint8), ends in ids (uint64);
* a footer of fixed size with the width, ids of a block, and numbers of ids and documents.

64 ids fill ``width`` words of 64 bits whatever the width is, so packing and unpacking
are one shift and one mask for each of the 64 lanes over a whole array. The offsets give
the blocks of any place, so a span of ids is read without the rest of the file.

``write_tokens`` deals documents to tasks by ranges of keys, a key of many documents to several
neighbouring tasks, and each task sorts its own and writes them in turn. A task writes files
under names of its own and tells their names in a manifest that Spark commits; a file of a
lost or repeated task is in no manifest and is never read. The folder must be one that
``pyarrow.fs`` opens in the workers.

Defined results: a null text counts as empty and has the end id alone; documents without
key come first, as if theirs were the smallest long; documents of equal keys are documents of
their own, in any order; an empty table gives a manifest without files; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.llm.bytelevel import spelled
from rinseframe.llm.frames import Scratch, fresh, without

LANES = 64
BLOCK_IDS = 1 << 13
#: ids and documents after which a task starts another file
FILE_IDS, FILE_DOCS = 1 << 25, 1 << 20
#: ids packed or unpacked at once
STRIP_IDS = 1 << 19
#: bytes of the documents of one task, and tasks at most; a task may write many files
PART_BYTES, MOST_PARTS = 64 << 20, 20_000
LEAST_KEY = -(1 << 63)
MAGIC = b"RFIDBITS"
FOOTER = struct.Struct("<IIQQ8s")
U64 = np.uint64
#: words and parts of words remembered by a Python worker: about 80 MB
REMEMBERED = 400_000
#: letters that stay single under NFC and have one lower-case letter each, then ASCII marks that begin nothing else
LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@\[-`{}~]*)")
#: called in a task: gives a function from cells to blobs of ids
Reading = Callable[[], Callable[[list], list[bytes]]]
FILES = "part int, no int, name string, n_docs long, n_ids long"
#: files whose starts are added up in one task
TOGETHER = 1000


# ---- bits


def width_of(vocabulary: int) -> int:
    """Bits of the largest id."""
    if not 1 <= vocabulary <= 1 << 32:
        raise ValueError("a vocabulary has 1 to 2^32 ids")
    return max(1, (vocabulary - 1).bit_length())


def kind_of(vocabulary: int) -> str:
    """How ids are handed to ``write_tokens``: little-endian, unsigned, in 16 bits where all fit, else in 32."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def lanes(width: int) -> Iterator[tuple[int, int, U64, U64]]:
    """(lane, word, shift, bits that reach into the next word) of 64 ids in ``width`` words."""
    for lane in range(LANES):
        word, shift = divmod(lane * width, 64)
        yield lane, word, U64(shift), U64(max(0, shift + width - 64))


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2^width as words of 64 bits; filled up to a multiple of 64 ids."""
    groups = -(-len(ids) // LANES)
    filled = np.zeros(groups * LANES, dtype=U64)
    filled[: len(ids)] = ids
    by_lane = np.ascontiguousarray(filled.reshape(groups, LANES).T)
    words = np.zeros((width, groups), dtype=U64)
    for lane, word, shift, over in lanes(width):
        words[word] |= by_lane[lane] << shift
        if over:
            words[word + 1] |= by_lane[lane] >> (U64(width) - over)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed words."""
    words = np.ascontiguousarray(np.frombuffer(data, dtype="<u8").reshape(-1, width).T)
    by_lane = np.empty((LANES, words.shape[1]), dtype=np.uint32)
    mask = U64((1 << width) - 1)
    for lane, word, shift, over in lanes(width):
        value = words[word] >> shift
        if over:
            value |= words[word + 1] << (U64(width) - over)
        by_lane[lane] = value & mask
    return np.ascontiguousarray(by_lane.T).reshape(-1)[:count]


# ---- one file


class Writer:
    """Documents appended one by one; packed a strip of whole blocks at a time."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.written = 0
        self.offsets, self.keys, self.ends = [0], [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"id {ids.max()} needs more than {self.width} bits")
        self.keys.append(key)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= STRIP_IDS:
            self.flush(self.n_waiting // BLOCK_IDS * BLOCK_IDS)

    def flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype=np.uint32)
        for at in range(0, count, STRIP_IDS):
            strip = ids[at : min(at + STRIP_IDS, count)]
            data = pack_bits(strip, self.width)
            blocks = np.arange(BLOCK_IDS, len(strip), BLOCK_IDS) // LANES * self.width * 8
            self.offsets += [self.written + int(b) for b in blocks] + [self.written + len(data)]
            self.written += len(data)
            self.sink.write(data)
        self.waiting, self.n_waiting = [ids[count:]], self.n_waiting - count

    def close(self) -> None:
        self.flush(self.n_waiting)
        self.sink.write(np.array(self.offsets, dtype="<u8").tobytes())
        self.sink.write(np.array([k or 0 for k in self.keys], dtype="<i8").tobytes())
        self.sink.write(np.array([k is not None for k in self.keys], dtype="u1").tobytes())
        self.sink.write(np.array(self.ends, dtype="<u8").tobytes())
        self.sink.write(FOOTER.pack(self.width, BLOCK_IDS, self.n_ids, len(self.keys), MAGIC))
        self.sink.close()


class Reader:
    """Random access to one file: its tables are read on opening, blocks when asked for."""

    def __init__(self, source):
        self.source = source
        footer = self.read(source.size() - FOOTER.size, FOOTER.size) if source.size() >= FOOTER.size else b""
        if footer[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a file of packed token ids")
        self.width, self.block_ids, self.n_ids, self.n_docs, _ = FOOTER.unpack(footer)
        n_blocks = -(-self.n_ids // self.block_ids)
        sizes = [8 * (n_blocks + 1), 8 * self.n_docs, self.n_docs, 8 * self.n_docs]
        tables = self.read(source.size() - FOOTER.size - sum(sizes), sum(sizes))
        edges = np.cumsum([0, *sizes])
        parts = [tables[a:b] for a, b in zip(edges[:-1], edges[1:])]
        self.offsets, self.keys, self.known, self.ends = (np.frombuffer(p, dtype=d) for p, d in zip(parts, ("<u8", "<i8", "u1", "<u8")))

    def read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(size)
        if len(data) != size:
            raise ValueError("a file of packed token ids is cut short")
        return data

    def ids(self, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length`` of the file; only their blocks are read."""
        if start < 0 or length < 0 or start + length > self.n_ids:
            raise IndexError("ids outside the file")
        if not length:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block_ids, -(-(start + length) // self.block_ids)
        at, end = int(self.offsets[first]), int(self.offsets[last])
        skipped = start - first * self.block_ids
        return unpack_bits(self.read(at, end - at), self.width, skipped + length)[skipped:]

    def document(self, i: int) -> np.ndarray:
        start = int(self.ends[i - 1]) if i else 0
        return self.ids(start, int(self.ends[i]) - start)

    def strips(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents with about ``STRIP_IDS`` ids, at least one document each."""
        first = 0
        while first < self.n_docs:
            begin = int(self.ends[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(self.ends, begin + STRIP_IDS, side="right")))
            yield first, end
            first = end


# ---- tables


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def with_scheme(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def key_bounds(sizes: DataFrame, part_bytes: int) -> list[int]:
    """Keys that part the (key, size) rows into ranges of about ``part_bytes``; a key of many rows may come repeatedly."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = min(MOST_PARTS, -(-total // part_bytes))
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sizes.agg(F.percentile_approx("key", shares, max(10_000, 10 * parts))).first()[0]


def part_of(key: Column, bounds: list[int]) -> Column:
    """The range of a key; rows of a key that is itself a bound are dealt in turn to the ranges it touches."""
    ordered = np.array(bounds, dtype=np.int64)

    def parts(key: pd.Series, turn: pd.Series) -> pd.Series:
        low, high = np.searchsorted(ordered, key, side="left"), np.searchsorted(ordered, key, side="right")
        return pd.Series((low + turn % (high - low + 1)).astype(np.int32))

    # Python sees the keys alone
    return F.pandas_udf(parts, T.IntegerType())(key, F.monotonically_increasing_id())


def write_tokens(
    df: DataFrame,
    path: str,
    key: str,
    column: str,
    vocabulary: int,
    reader: Reading | None = None,
    file_ids: int = FILE_IDS,
    file_docs: int = FILE_DOCS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Write the ids of all rows in ascending order of keys; returns the manifest.

    ``column`` holds ids as blobs of the vocabulary's ``kind_of``, or what ``reader`` makes such
    blobs of: it is called once in a task and gives a function from a list of cells to a list
    of blobs. Rows are dealt to tasks by ranges of keys, so ``column`` is shuffled once. The
    manifest has a row for each file: name, order, number of documents and ids, and the ids
    before it in all files (``start``).
    """
    spark, scratch, width, kind = df.sparkSession, Scratch(df.sparkSession), width_of(vocabulary), kind_of(vocabulary)
    table = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{column}`").alias("cell"))
    ordered_key = F.coalesce("key", F.lit(LEAST_KEY))
    size = F.coalesce(F.octet_length("cell"), F.lit(0)) + 1
    bounds = key_bounds(table.select(ordered_key.alias("key"), size.alias("size")), part_bytes)
    folder = with_scheme(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        read = reader() if reader else None
        part, done, writer, name = TaskContext.get().partitionId(), [], None, ""
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                cells = batch.column(1).to_pylist()
                for k, blob in zip(batch.column(0).to_pylist(), read(cells) if read else cells):
                    if writer is None:
                        name = f"{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids"
                        files.create_dir(root, recursive=True)
                        writer = Writer(files.open_output_stream(f"{root}/{name}"), width)
                    writer.add(k, np.frombuffer(blob or b"", dtype=kind))
                    if writer.n_ids >= file_ids or len(writer.keys) >= file_docs:
                        writer.close()
                        done.append((part, len(done), name, len(writer.keys), writer.n_ids))
                        writer = None
        if writer:
            writer.close()
            done.append((part, len(done), name, len(writer.keys), writer.n_ids))
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "no", "name", "n_docs", "n_ids"])

    part = part_of(ordered_key, bounds) if bounds else F.lit(0)
    dealt = table.withColumn("part", part).repartitionById(len(bounds) + 1, "part")
    in_order = dealt.sortWithinPartitions("key").select("key", "cell")
    written = scratch.stored(in_order.mapInArrow(write, FILES), "files")
    with_starts(written).write.parquet(f"{path}/manifest")
    scratch.drop(written)
    return manifest(spark, path)


def with_starts(files: DataFrame) -> DataFrame:
    """Add the ids before each file: running sums within ``TOGETHER`` parts, after those of the parts before."""
    bucketed = files.withColumn("bucket", F.expr(f"part div {TOGETHER}"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bucketed.groupBy("bucket").agg(F.sum("n_ids").alias("base"))
    bases = bases.select("bucket", F.coalesce(F.sum("base").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("bucket").orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))
    return bucketed.join(bases, "bucket").select(*files.columns, start.alias("start"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{FILES}, start long").parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of every document; ids as little-endian unsigned 32-bit blobs."""
    folder = with_scheme(path)
    names = [key, "start", "n_tokens", "ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(f"{root}/{name}") as source:
                    yield from documents(Reader(source), base)

    def documents(reader: Reader, base: int) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate([[0], reader.ends]).astype(np.int64)
        for first, end in reader.strips():
            here = edges[first : end + 1]
            data = reader.ids(int(here[0]), int(here[-1] - here[0])).astype("<u4")
            offsets = ((here - here[0]) * 4).astype(np.int32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            keys = pa.array(reader.keys[first:end], mask=reader.known[first:end] == 0)
            columns = [keys, pa.array(here[:-1] + base), pa.array(np.diff(here)), blobs]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    files = manifest(spark, path).select("name", "start")
    # files of similar size dealt in turn; the number is given, so tasks are not put together for being small
    dealt = files.repartition(max(1, files.count()))
    return dealt.mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids binary")


def read_spans(spark: SparkSession, path: str, spans: DataFrame, start: str = "start", length: str = "length") -> DataFrame:
    """Random access: for each (start, length) row of ids counted over all files, a row for each file it touches.

    Adds ``at`` (the first id read), ``n_ids`` and ``ids``; only the blocks of a span are read.
    Spans are matched to files over cells of ``FILE_IDS`` ids. Parts outside all files give no row.
    """
    spans = without(spans, "at", "n_ids", "ids")
    names = {n: fresh(spans, n) for n in ("cell", "file_name", "file_start", "file_ids", "file_cell")}
    begin, end = F.col(f"`{start}`"), F.col(f"`{start}`") + F.col(f"`{length}`")

    def cells(first, last):
        return F.explode(F.sequence(F.expr(f"{first} div {FILE_IDS}"), F.expr(f"({last} - 1) div {FILE_IDS}")))

    wanted = spans.where((F.col(f"`{length}`") > 0) & (begin >= 0))
    wanted = wanted.withColumn(names["cell"], cells(f"`{start}`", f"(`{start}` + `{length}`)"))
    held = manifest(spark, path).where("n_ids > 0").select(
        F.col("name").alias(names["file_name"]), F.col("start").alias(names["file_start"]), F.col("n_ids").alias(names["file_ids"]),
        cells("start", "(start + n_ids)").alias(names["file_cell"]),
    )
    from_, to = F.greatest(begin, names["file_start"]), F.least(end, F.col(names["file_start"]) + F.col(names["file_ids"]))
    met = wanted.join(held, F.col(names["cell"]) == F.col(names["file_cell"])).where(from_ < to)
    met = met.where(F.col(names["cell"]) == F.expr(f"greatest(`{start}`, {names['file_start']}) div {FILE_IDS}"))  # once a file
    plain = [F.col(f"`{c}`") for c in spans.columns]
    asked = met.select(*plain, from_.alias("at"), (to - from_).alias("n_ids"), names["file_start"], names["file_name"])
    width, folder = len(spans.columns), with_scheme(path)
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields] + ["at long, n_ids long, ids binary"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        opened, reader = "", None
        for batch in batches:
            at, count, base, name = (batch.column(width + i).to_pylist() for i in range(4))
            blobs = []
            for i in range(batch.num_rows):
                if name[i] != opened:
                    opened, reader = name[i], Reader(files.open_input_file(f"{root}/{name[i]}"))
                blobs.append(reader.ids(at[i] - base[i], count[i]).astype("<u4").tobytes())
            columns = [*batch.columns[: width + 2], pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: width + 2], "ids"])

    return asked.repartition(names["file_name"]).sortWithinPartitions(names["file_name"], "at").mapInArrow(read, fields)


# ---- ids of whole texts


class WordEncoder:
    """Ids of a tokenizer file that never joins what a blank or line end parts.

    Words met before are looked up. A new word of Latin letters and the marks after it is put
    together from both, the letters by the file's merge model alone where that gives the same
    ids; other new words go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.kind = kind_of(self.tokenizer.get_vocab_size())
        self.code = "H" if self.kind == "<u2" else "I"
        self.known: dict[str, bytes] = {"": b""}
        words = ["Ab'c", "12", "x<y", "É", "été,", "OFF..", "ÑANDÚ(!)", "straßeí", "thequickbrownfox:", "a", "zzzzxq###"]
        if self.ids(" \n".join(words)) != b"".join(map(self.ids, words)):
            raise ValueError("the tokenizer does not encode words by themselves")
        self.parted = all(self.of_parts(m) == self.ids(m[0]) for m in map(LETTERS_MARKS.fullmatch, words) if m)
        self.known = {"": b""}

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_parts(self, match: re.Match) -> bytes:
        letters, marks = match[1].lower(), match[2]
        blob, after = self.known.get(letters), self.known.get(marks)
        if blob is None:
            blob = array(self.code, [t.id for t in self.merges.tokenize(letters.translate(BYTE_LEVEL))]).tobytes()
            self.remember(letters, blob)
        if after is None:
            after = self.ids(marks)
            self.remember(marks, after)
        return blob + after

    def remember(self, word: str, blob: bytes) -> None:
        if len(self.known) < REMEMBERED and len(word) <= 64:
            self.known[word] = blob

    def new(self, word: str) -> bytes:
        match = LETTERS_MARKS.fullmatch(word) if self.parted else None
        blob = self.of_parts(match) if match else self.ids(word)
        self.remember(word, blob)
        return blob

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as a blob of ``kind``."""
        words = text.replace("\n", " ").split(" ")
        blobs = list(map(self.known.get, words))
        if None in blobs:
            blobs = [self.new(words[i]) if blob is None else blob for i, blob in enumerate(blobs)]
        return b"".join(blobs)


#: the letters above 127 as a byte-level vocabulary spells them
BYTE_LEVEL = {c: spelled(chr(c)) for c in range(0xC0, 0x100)}


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def vocabulary_of(tokenizer_path: str) -> int:
    return word_encoder(tokenizer_path).tokenizer.get_vocab_size()


def text_reader(tokenizer_path: str, end_id: int) -> Reading:
    """Texts as blobs of their ids with the end id, for ``write_tokens``."""

    def reader() -> Callable[[list], list[bytes]]:
        own = word_encoder(tokenizer_path)
        end = np.array([end_id], dtype=own.kind).tobytes()
        return lambda texts: [own.encode(t or "") + end for t in texts]

    return reader
