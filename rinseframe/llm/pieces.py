"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Words not met before are laid out as one flat array of symbols. In each round every word
finds its pair of smallest rank, the leftmost such pair of every word is merged at the same
time, the array is compacted, and words without a pair that can merge leave. The ranks
and pieces come from the model file; merging is done here. Adjacent characters that stand
next to each other in no piece can never merge, so texts are cut there first. Runs too long
for rounds, more than ``LONGEST`` symbols without such a cut, are merged pair by pair from
a heap, in the same order.

Words are remembered in a bounded table, so most words of a text are looked up.

Defined results: a null text counts as empty and has no ids; any text can be encoded,
characters outside the vocabulary as their bytes; repeated rows are encoded each; an empty
table stays empty; input columns named like an added column are replaced.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.frames import fresh, without

SPACE = "▁"
#: words remembered by a Python worker: about 60 MB
REMEMBERED = 250_000
LONGEST = 256
#: words merged at once
TOGETHER = 100_000
NEVER = np.int32(2**31 - 1)
#: symbols at and above this are characters that no piece has
OUTSIDE = 1 << 21


def each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("replace_each_byte", each_byte)


class Model:
    """Pieces, ranks and pair table of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = own.get_piece_size()
        normal = [not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i)) for i in range(size)]
        folds = own.encode("  x") in (own.encode(" x"), own.encode("x"))
        if folds or own.decode(own.encode(" Ａ  b")) != " Ａ  b":
            raise ValueError("the model changes texts before it encodes them")
        pieces = {own.id_to_piece(i): i for i in range(size) if normal[i]}
        scores = {own.get_score(i) for i in pieces.values()}
        rank_of = {s: r for r, s in enumerate(sorted(scores, reverse=True))}
        self.bytes_at = next(i for i in range(size) if own.is_byte(i))
        characters = {c for p in pieces for c in p}
        symbols = dict(pieces)
        for c in sorted(characters - set(pieces)):
            symbols[c] = size + len(symbols)
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + OUTSIDE
        for c in characters:
            self.symbol_of[ord(c)] = symbols[c]
        pairs, neighbours = {}, set()
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                neighbours.add(ord(piece[cut - 1]) << 21 | ord(piece[cut]))
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank_of[own.get_score(i)], i)
        keys = sorted(pairs)
        self.pair_keys = np.array(keys, dtype=np.int64)
        self.pair_ranks = np.array([pairs[k][0] for k in keys], dtype=np.int32)
        self.pair_merged = np.array([pairs[k][1] for k in keys], dtype=np.int32)
        self.neighbours = np.array(sorted(neighbours), dtype=np.int64)
        self.pairs = pairs
        self.line_ends_stand_alone = not any("\n" in p for p in pieces if len(p) > 1)
        self.outside = {}  # symbol of a character without a piece: its byte ids
        for c in characters - set(pieces):
            self.outside[symbols[c]] = [self.bytes_at + b for b in c.encode()]
        self.surface = [
            bytes([i - self.bytes_at]) if own.is_byte(i) else own.id_to_piece(i).replace(SPACE, " ").encode() if normal[i] else b""
            for i in range(size)
        ]
        if own.unk_id() >= 0:
            self.surface[own.unk_id()] = " ⁇ ".encode()
        self.size, self.is_byte = size, own.is_byte
        self.known: dict[str, bytes] = {}

    # ---- encoding

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; NEVER where they do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NEVER), self.pair_merged[at]

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian int32 blobs."""
        characters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        cut = np.ones(len(characters), dtype=bool)
        adjacent = characters[:-1] << 21 | characters[1:]
        at = np.minimum(np.searchsorted(self.neighbours, adjacent), max(len(self.neighbours) - 1, 0))
        cut[1:] = (self.neighbours[at] != adjacent) | (word[1:] != word[:-1])
        run = np.cumsum(cut) - 1
        runs = np.append(run[np.cumsum(lengths) - lengths], run[-1] + 1)
        symbol, run = self.rounds(self.symbol_of[characters], run)
        edges = np.searchsorted(run, runs)
        return [self.ids_of(symbol[a:b]) for a, b in zip(edges[:-1], edges[1:])]

    def ids_of(self, symbols: np.ndarray) -> bytes:
        if symbols.max(initial=0) < self.size:
            return symbols.astype("<i4").tobytes()
        ids = []
        for s in symbols.tolist():
            if s < self.size:
                ids.append(s)
            else:
                ids.extend(self.outside.get(s) or [self.bytes_at + b for b in chr(s - OUTSIDE).encode("utf-8", "surrogatepass")])
        return np.array(ids, dtype="<i4").tobytes()

    def rounds(self, symbol: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every run until no pair remains; the symbols that are left and their runs, in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.bincount(run)
        for long in np.flatnonzero(sizes > LONGEST):
            merged = self.by_heap(symbol[run == long])
            done.append((merged, np.full(len(merged), long)))
        short = (sizes <= LONGEST)[run]
        symbol, run = symbol[short], run[short]
        rank, merged = self.pair_ranks_of(symbol, run)
        while len(symbol):
            begins = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            least = np.minimum.reduceat(rank, begins)
            lengths = np.diff(np.append(begins, len(run)))
            lowest = np.repeat(least, lengths)
            ended = lowest == NEVER
            if ended.any():
                done.append((symbol[ended], run[ended]))
                going = ~ended
                symbol, run, rank, merged, lowest = symbol[going], run[going], rank[going], merged[going], lowest[going]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == lowest)
            at = at[np.append(True, run[at][1:] != run[at][:-1])]  # leftmost of each run
            symbol[at] = merged[at]
            rest = np.ones(len(symbol), dtype=bool)
            rest[at + 1] = False
            symbol, run, rank, merged = symbol[rest], run[rest], rank[rest], merged[rest]
            now = at - np.arange(len(at))
            before = now[now > 0] - 1
            for places in (now, before):
                inside = places[places + 1 < len(symbol)]
                inside = inside[run[inside] == run[inside + 1]]
                rank[places] = NEVER
                rank[inside], merged[inside] = self.lookup(symbol[inside], symbol[inside + 1])
        if not done:
            return symbol, run
        symbols, runs = (np.concatenate(parts) for parts in zip(*done))
        order = np.argsort(runs, kind="stable")
        return symbols[order], runs[order]

    def pair_ranks_of(self, symbol: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(symbol), NEVER, dtype=np.int32), np.zeros(len(symbol), dtype=np.int32)
        if len(symbol) > 1:
            found, into = self.lookup(symbol[:-1], symbol[1:])
            same = run[:-1] == run[1:]
            rank[:-1], merged[:-1] = np.where(same, found, NEVER), into
        return rank, merged

    def by_heap(self, symbols: np.ndarray) -> np.ndarray:
        """One long run, merged in the order of rank, then place."""
        symbol = symbols.tolist()
        following = list(range(1, len(symbol))) + [-1]
        before = list(range(-1, len(symbol) - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            found = self.pairs.get(symbol[i] << 32 | symbol[j])
            if found:
                heapq.heappush(heap, (found[0], i, j, symbol[i], symbol[j], found[1]))

        for i in range(len(symbol) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, left, right, into = heapq.heappop(heap)
            if symbol[i] != left or symbol[j] != right or following[i] != j:
                continue
            symbol[i], symbol[j] = into, -1
            following[i] = following[j]
            if following[j] >= 0:
                before[following[j]] = i
                offer(i, following[j])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([s for s in symbol if s >= 0], dtype=np.int32)

    def words(self, text: str) -> list[str]:
        """The text cut where nothing can merge: before a space mark that follows something else, and around line ends."""
        if not text:
            return []
        if "  " not in text and SPACE not in text:
            first, *rest = text.split(" ")
            chunks = [SPACE + first, *[SPACE + c for c in rest]] if first else [SPACE * 2 + rest[0], *[SPACE + c for c in rest[1:]]]
        else:
            chunks = SPACED.findall(SPACE + text.replace(" ", SPACE))
        if self.line_ends_stand_alone and "\n" in text:
            chunks = [part for c in chunks for part in (LINES.findall(c) if "\n" in c else (c,))]
        return chunks

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cut = [self.words(t) for t in texts]
        new = list({w for words in cut for w in words if w not in self.known})
        fresh_words: dict[str, bytes] = {}
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            fresh_words.update(zip(part, self.merged(part)))
        if len(self.known) < REMEMBERED:
            self.known.update((w, b) for w, b in fresh_words.items() if len(w) <= 64)
        table = self.known
        if fresh_words:
            found = [[table.get(w) or fresh_words[w] for w in words] for words in cut]
        else:
            found = [[table[w] for w in words] for words in cut]
        return [np.frombuffer(b"".join(blobs), dtype="<i4") for blobs in found]

    # ---- decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids: space marks become blanks, the mark put before a text goes."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        if ids and data[:1] == b" " and not self.is_byte(ids[0]):
            data = data[1:]
        return data.decode("utf-8", "replace_each_byte")


SPACED = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
LINES = re.compile("\n|[^\n]+")


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encoded(df: DataFrame, text_col: str, model_path: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Replace the text by its ids (``array<int>``), and by what these decode to if ``decoded`` names a column."""
    added = [ids] + ([decoded] if decoded else [])
    df = without(df, *[a for a in added if a.lower() != text_col.lower()])
    kept = [c for c in df.columns if c.lower() != text_col.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(fresh(df, "text_to_encode")))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{ids}` array<int>"]
    kinds += [f"`{decoded}` string"] if decoded else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = own.encode_all([t or "" for t in batch.column(len(kept)).to_pylist()])
                offsets = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(f) for f in found], out=offsets[1:])
                flat = np.concatenate(found) if found else np.empty(0, dtype=np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
                if decoded:
                    columns.append(pa.array([own.decode(f.tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *added])

    return source.mapInArrow(encode, ", ".join(kinds))
