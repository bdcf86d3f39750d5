"""Repeated passages between documents, found from difference-cover anchors.

The window of ``length`` words is what has to repeat. Windows of ``length - 6`` words are
fingerprinted at places that are 1, 2 or 4 modulo 7 only: for any two places some shift
below 7 takes both to such a place, so two equal passages of ``length`` words, wherever
they stand, share an aligned anchor. Anchors that two documents share are then extended:
only passages of full length around them are fingerprinted, in 128 bits, and the smallest
document of each is found. Between the passes over the texts only sorted arrays of
fingerprints travel, one blob for each (group of documents, range of fingerprints).

The rows are stored once, numbered and dealt to groups of neighbours by their bytes, so a
group is bounded however many rows are equal; a text above the bound is a group of its own.
The table is bucketed by group: texts are shuffled once, when it is written, and each pass
then meets its answers where the texts lie. Ranges are
hash buckets whose number follows the bytes of the table. Within a group every fingerprint
is sent once, however often it occurs, so a passage in a third of all documents adds at
most one entry per group to its range.

Defined results: a null text has no words; documents with null ids come after all others
and do not repeat each other; rows with equal ids do not repeat each other; texts shorter
than the window stay whole but for white space; an empty table stays empty; input columns
named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.fingerprints import U64, batch_words, windows
from rinseframe.llm.frames import Scratch, fresh, without
from rinseframe.plans.lineage import shuffle_partitions

#: a perfect difference cover: every residue modulo 7 is a difference of two of these
PERIOD, COVER = 7, (1, 2, 4)
#: text bytes of one group of documents, and of one range of anchors
GROUP_BYTES, RANGE_BYTES = 2 << 20, 8 << 20
#: text bytes of one bucket of groups, and buckets at most
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 50_000
LAST_ID = np.iinfo(np.int64).max
SECOND = 0xA24BAED4963EE407


def covered(length: int) -> np.ndarray:
    return np.isin(np.arange(length) % PERIOD, COVER)


def window_starts(counts: np.ndarray, firsts: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which places of the flat word array begin a window of ``k`` words within one text."""
    change = np.zeros(total + 1, dtype=np.int64)
    has = counts >= k
    np.add.at(change, firsts[has], 1)
    np.add.at(change, firsts[has] + counts[has] - k + 1, -1)
    return np.cumsum(change[:-1]).astype(bool)


class Group:
    """The words of a group of documents, as flat arrays."""

    def __init__(self, texts: pa.Array, length: int):
        self.words, firsts = batch_words(texts)
        self.firsts, self.counts = firsts[:-1], np.diff(firsts)
        self.total, self.length = len(self.words), length
        self.document = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(self.total) - np.repeat(self.firsts, self.counts)
        self.starts = window_starts(self.counts, self.firsts, length, self.total)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and fingerprints of the anchors of texts that have a full window."""
        k = self.length - PERIOD + 1
        prints = windows(self.words, k)
        begins = window_starts(np.where(self.counts >= self.length, self.counts, 0), self.firsts, k, self.total)
        places = np.flatnonzero(begins & np.isin(self.place % PERIOD, COVER))
        return places, prints[places]

    def passages(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return windows(self.words, self.length)[chosen], windows(self.words, self.length, SECOND)[chosen]

    def extended(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the full windows that hold an anchor out of ``shared`` (sorted)."""
        places, prints = self.anchors()
        hit = places[member(prints, shared)]
        near = np.zeros(self.total + 1, dtype=np.int64)
        np.add.at(near, np.maximum(hit - PERIOD + 1, 0), 1)
        np.add.at(near, hit + 1, -1)
        return np.flatnonzero(self.starts & (np.cumsum(near[:-1]) > 0))


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def range_of(prints: np.ndarray, ranges: int) -> np.ndarray:
    """The range a fingerprint belongs to: equal parts of the upper 32 bits."""
    return ((prints >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


def blobs(arrays: list[np.ndarray], cuts: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The non-empty slices of arrays between neighbouring cuts."""
    for r in np.flatnonzero(np.diff(cuts)):
        yield int(r), [a[cuts[r] : cuts[r + 1]].tobytes() for a in arrays]


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def sizes_of(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def dealt(df: DataFrame, text_col: str, row: str, group: str, group_bytes: int) -> DataFrame:
    """The rows with a number of their own and a group of neighbours with about ``group_bytes`` of text."""
    at = df.columns.index(text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = groups = TaskContext.get().partitionId() << 33
        held = 0
        for batch in batches:
            before = held + np.cumsum(sizes_of(batch.column(at)))
            number = groups + before // group_bytes
            held, groups = (int(before[-1] % group_bytes), int(number[-1])) if batch.num_rows else (held, groups)
            added = [pa.array(np.arange(rows, rows + batch.num_rows)), pa.array(number)]
            rows += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, row, group])

    return df.mapInArrow(deal, f"{kinds}, `{row}` long, `{group}` long")


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """Remove every word of a passage of ``length`` words that also starts in a document of smaller id.

    Passages are judged on the input. Kept words are joined by one blank in the text column;
    ``n_words`` and ``n_removed`` are added.
    """
    if length <= PERIOD:
        raise ValueError(f"windows need more than {PERIOD} words")
    df = without(df, "n_words", "n_removed")
    scratch, row, group = Scratch(df.sparkSession), fresh(df, "row"), fresh(df, "document_group")
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    ranges, buckets = -(-size // RANGE_BYTES) or 1, min(-(-size // BUCKET_BYTES) or 1, MOST_BUCKETS)
    buckets = max(buckets, min(shuffle_partitions(df.sparkSession), -(-size // GROUP_BYTES) or 1))
    rows = scratch.bucketed(dealt(df, text_col, row, group, GROUP_BYTES), group, buckets, "rows")
    slim = rows.select(
        F.col(group).alias("group"), F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
    )
    shared = scratch.stored(shared_anchors(slim, length, ranges), "anchors")
    spans = scratch.stored(repeated_spans(passages(slim, shared, length, ranges), length), "spans")
    scratch.drop(shared)
    return removed(rows, spans, row, group, text_col)


def shared_anchors(slim: DataFrame, length: int, ranges: int) -> DataFrame:
    """(receiver, prints): anchors found in two documents at least, as blobs for each group that has them."""
    sent = pa.schema([("part", pa.int64()), ("sender", pa.int64()), ("prints", pa.binary()), ("often", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.asarray(batch.column(0))
            begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []
            for first, end in zip(begins, [*begins[1:], len(group)]):
                found = anchors_of(batch.column(1).slice(first, end - first), int(group[first]))
                yield from table(sent, found).to_batches()

    def anchors_of(column: pa.Array, sender: int) -> list[tuple]:
        texts = Group(column, length)
        places, prints = texts.anchors()
        order = np.lexsort((texts.document[places], prints))
        prints, document = prints[order], texts.document[places][order]
        first = np.ones(len(prints), dtype=bool)
        first[1:] = prints[1:] != prints[:-1]
        begin = np.flatnonzero(first)
        often = np.zeros(len(begin), dtype=np.uint8)
        if len(begin):
            often = (np.maximum.reduceat(document, begin) > document[begin]).astype(np.uint8)
        prints = prints[begin]
        cuts = np.searchsorted(range_of(prints, ranges), np.arange(ranges + 1))
        return [(r, sender, *b) for r, b in blobs([prints, often], cuts)]

    back = pa.schema([("receiver", pa.int64()), ("prints", pa.binary())])

    def meet(key: tuple, parts: pa.Table) -> pa.Table:
        prints, often = joined(parts.column("prints"), U64), joined(parts.column("often"), np.uint8)
        ordered = np.sort(prints)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        kept = (often > 0) | member(prints, twice)
        rows, at = [], 0
        for sender, blob in zip(parts.column("sender").to_pylist(), parts.column("prints").to_pylist()):
            here = slice(at, at + len(blob) // 8)
            at = here.stop
            if kept[here].any():
                rows.append((sender, prints[here][kept[here]].tobytes()))
        return table(back, rows)

    meeting = slim.select("group", "text").mapInArrow(send, "part long, sender long, prints binary, often binary")
    return meeting.groupBy("part").applyInArrow(meet, "receiver long, prints binary")


PASSAGES = "part long, sender long, base long, upper binary, lower binary, first binary, often binary"


def passages(slim: DataFrame, shared: DataFrame, length: int, ranges: int) -> DataFrame:
    """For each group its distinct passages that hold a shared anchor, cut by range, and a row with where they are.

    Passages are 128-bit fingerprints with the group's smallest document id; ``base`` counts those before.
    The row of places has a negative part of its own: ids and numbers of the ``base`` documents, the
    passage at each place, and the places as runs (document, first word, length).
    """
    names = [part.split()[0] for part in PASSAGES.split(", ")]
    sent = pa.schema([(n, pa.int64() if n in names[:3] else pa.binary()) for n in names])

    def send(key: tuple, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not anchors.num_rows or not docs.num_rows:
            return table(sent, [])
        texts, sender = Group(docs.column("text").combine_chunks(), length), key[0].as_py()
        chosen = texts.extended(np.sort(joined(anchors.column("prints"), U64)))
        ids = np.asarray(docs.column("id").combine_chunks().fill_null(LAST_ID))
        upper, lower = texts.passages(chosen)
        begin, (upper, lower, own, index) = ordered_runs(upper, lower, ids[texts.document[chosen]], np.arange(len(chosen)))
        if not len(begin):
            return table(sent, [])
        often = (np.maximum.reduceat(own, begin) > own[begin]).astype(np.uint8)
        entry = np.empty(len(chosen), dtype="<u4")
        entry[index] = np.repeat(np.arange(len(begin), dtype="<u4"), np.diff(np.append(begin, len(chosen))))
        numbers = np.asarray(docs.column("row").combine_chunks())
        places = (-1 - sender, sender, len(numbers), ids.tobytes() + numbers.tobytes(), entry.tobytes(), runs_of(texts, chosen), b"")
        upper = upper[begin]
        cuts = np.searchsorted(range_of(upper, ranges), np.arange(ranges + 1))
        found = blobs([upper, lower[begin], own[begin], often], cuts)
        return table(sent, [(r, sender, int(cuts[r]), *b) for r, b in found] + [places])

    return slim.groupBy("group").cogroup(shared.groupBy("receiver")).applyInArrow(send, PASSAGES)


def runs_of(texts: Group, chosen: np.ndarray) -> bytes:
    """Neighbouring places as (document, first word, length)."""
    apart = np.ones(len(chosen), dtype=bool)
    apart[1:] = (chosen[1:] != chosen[:-1] + 1) | (texts.document[chosen[1:]] != texts.document[chosen[:-1]])
    begin = np.flatnonzero(apart)
    first = chosen[begin]
    lengths = np.diff(np.append(begin, len(chosen)))
    return np.stack([texts.document[first], texts.place[first], lengths]).astype("<u4").tobytes()


def repeated_spans(found: DataFrame, length: int) -> DataFrame:
    """(receiver, number, spans): first and end word of the parts of each row that repeat a smaller document, as a blob.

    Places pass through with the answers, so the passages are computed once and stored nowhere.
    """
    back = pa.schema([("receiver", pa.int64()), ("base", pa.int64()), *[(n, pa.binary()) for n in ("entry", "first", "runs")]])

    def meet(key: tuple, parts: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            places = (parts.column(c).to_pylist() for c in ("sender", "base", "lower", "upper", "first"))
            return table(back, list(zip(*places)))
        upper, lower = joined(parts.column("upper"), U64), joined(parts.column("lower"), U64)
        own, often = joined(parts.column("first"), np.int64), joined(parts.column("often"), np.uint8)
        index = np.arange(len(upper))
        begin, (_, _, first, index) = ordered_runs(upper, lower, own, index)
        smallest = np.empty(len(upper), dtype=np.int64)
        if len(begin):
            smallest[index] = np.repeat(first[begin], np.diff(np.append(begin, len(upper))))
        kept = (smallest < own) | (often > 0)
        rows, at = [], 0
        for sender, base, size in zip(*(parts.column(c).to_pylist() for c in ("sender", "base")), map(len, parts.column("often").to_pylist())):
            here = slice(at, at + size)
            at = here.stop
            if kept[here].any():
                entry = (base + np.flatnonzero(kept[here])).astype("<u4")
                rows.append((sender, -1, entry.tobytes(), smallest[here][kept[here]].tobytes(), b""))
        return table(back, rows)

    spans = pa.schema([("receiver", pa.int64()), ("number", pa.int64()), ("spans", pa.binary())])

    def apply(key: tuple, rows: pa.Table) -> pa.Table:
        base = np.asarray(rows.column("base").combine_chunks())
        answers, own = rows.filter(pa.array(base < 0)), rows.filter(pa.array(base >= 0)).to_pylist()
        if not answers.num_rows:
            return table(spans, [])
        answered, first = joined(answers.column("entry"), "<u4"), joined(answers.column("first"), np.int64)
        smallest = np.full(int(answered.max()) + 1, LAST_ID)
        smallest[answered] = first
        result = []
        for places in own:
            ids, numbers = np.frombuffer(places["first"], dtype=np.int64).reshape(2, places["base"])
            entry = np.frombuffer(places["entry"], dtype="<u4")
            document, start, count = np.frombuffer(places["runs"], dtype="<u4").astype(np.int64).reshape(3, -1)
            place = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count - start, count)
            document = np.repeat(document, count)
            known = np.flatnonzero(entry < len(smallest))
            hit = known[smallest[entry[known]] < ids[document[known]]]
            result += [(key[0].as_py(), *found) for found in spans_of(document[hit], place[hit], numbers)]
        return table(spans, result)

    def spans_of(document: np.ndarray, place: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, bytes]]:
        apart = np.ones(len(place), dtype=bool)
        apart[1:] = (document[1:] != document[:-1]) | (place[1:] > place[:-1] + length)
        begin = np.flatnonzero(apart)
        end = np.append(begin[1:], len(place)) - 1
        both = np.stack([place[begin], place[end] + length], axis=1).astype("<u4")
        owner = document[begin]
        change = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
        for a, b in zip(change, [*change[1:], len(owner)]):
            yield int(numbers[owner[a]]), both[a:b].tobytes()

    kinds = "receiver long, base long, entry binary, first binary, runs binary"
    met = found.groupBy("part").applyInArrow(meet, kinds)
    return met.groupBy("receiver").applyInArrow(apply, "receiver long, number long, spans binary")


def ordered_runs(upper: np.ndarray, lower: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Sort by the 128-bit fingerprint, then by the first of ``more``; where each run of equal ones begins."""
    order = np.lexsort((more[0], lower, upper))
    upper, lower, *more = (a[order] for a in (upper, lower, *more))
    first = np.ones(len(upper), dtype=bool)
    first[1:] = (upper[1:] != upper[:-1]) | (lower[1:] != lower[:-1])
    return np.flatnonzero(first), (upper, lower, *more)


def removed(rows: DataFrame, spans: DataFrame, row: str, group: str, text_col: str) -> DataFrame:
    """The rows with the words of their spans taken out of their texts."""
    columns = [c for c in rows.columns if c not in (row, group)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in columns)

    def cut(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        blobs_of = dict(zip(found.column("number").to_pylist(), found.column("spans").to_pylist()))
        kept, counts, taken = [], [], []
        for text, number in zip(docs.column(text_col), docs.column(row).to_pylist()):
            words, blob = (text.as_py() or "").encode().split(), blobs_of.get(number)
            counts.append(len(words))
            if blob:
                parts, begin = [], 0
                for a, b in np.frombuffer(blob, dtype="<u4").reshape(-1, 2).tolist():
                    parts += words[begin:a]
                    begin = b
                words = parts + words[begin:]
            taken.append(counts[-1] - len(words))
            kept.append(b" ".join(words).decode())
        arrays = [pa.array(kept, pa.string()) if c == text_col else docs.column(c) for c in columns]
        added = [pa.array(counts, pa.int64()), pa.array(taken, pa.int64())]
        return pa.Table.from_arrays([*arrays, *added], names=[*columns, "n_words", "n_removed"])

    both = rows.groupBy(group).cogroup(spans.groupBy("receiver"))
    return both.applyInArrow(cut, f"{kinds}, n_words long, n_removed long")
