"""Best-fit packing planned on a histogram of lengths.

A plan needs only how many pieces there are of each length, at most ``capacity``
numbers. Best fit in order of falling length runs over groups of equal bins on the
driver, whose work and memory depend on the capacity and not on the data. The plan is a
short list of runs "pieces of this length, ranks from .. to, into these bins at this
place", and pieces take their place by joining it on their rank within their length.

Defined results: a null text counts as empty, so it is one end token; repeated rows are
packed as rows of their own; pieces of equal length take slots in table order; an empty
table gives no pieces. ``pack`` gives rows whose length is null, below one or above the
capacity no place (null). Input columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.frames import Scratch, fresh, number, with_rows, without
from rinseframe.llm.tokens import encoder

Run = tuple[int, int, int, int, int, int]
PIECE_SCHEMA = "piece int, start long, length long, ids binary"


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs (length, first rank, end rank, first bin, pieces per bin, place) of best fit by falling length.

    All bins of a group have the same space left and consecutive numbers. The tightest
    group that takes the length is filled, as many pieces per bin as fit, before the next.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # space left -> (first bin, bins)
    runs: list[Run] = []
    used = 0

    def put(space: int, first: int, bins: int) -> None:
        if bins and space:
            open_bins.setdefault(space, []).append((first, bins))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        spaces = iter(sorted(s for s in open_bins if s >= length))
        while left:
            space = next(spaces, None)
            if space is None:
                per_bin = capacity // length
                groups = [(used, -(-left // per_bin))]
                used, space = used + groups[0][1], capacity
            else:
                per_bin = space // length
                groups = open_bins.pop(space)
            for k, (first, bins) in enumerate(groups):
                if not left:
                    for group in groups[k:]:
                        put(space, *group)
                    break
                taken = min(left, bins * per_bin)
                runs.append((length, rank, rank + taken, first, per_bin, capacity - space))
                rank, left = rank + taken, left - taken
                full, partly = divmod(taken, per_bin)
                put(space - per_bin * length, first, full)
                if partly:
                    put(space - partly * length, first + full, 1)
                put(space, first + full + bool(partly), bins - full - bool(partly))
    return runs


def pack(df: DataFrame, length: str, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: bins of the capacity, as few as best fit finds."""
    df = without(df, "sequence_id", "offset")
    row, rank = fresh(df, "row"), fresh(df, "rank_in_length")
    table = with_rows(df, Scratch(df.sparkSession), row)
    histogram = table.where(F.col(length).between(1, capacity)).groupBy(length).count()
    counts = {r[0]: r[1] for r in histogram.collect()}  # at most one row for each length
    return place(number(table, row, length, rank), length, rank, plan(counts, capacity))


def place(ranked: DataFrame, length: str, rank: str, runs: list[Run]) -> DataFrame:
    """Join each row to the run that holds its rank; the runs are bounded by the capacity alone."""
    spark = ranked.sparkSession
    schema = "run_length long, run_from long, run_to long, first_bin long, per_bin long, place long"
    table = F.broadcast(spark.createDataFrame(runs, schema))
    here = (F.col(length) == F.col("run_length")) & (F.col(rank) >= F.col("run_from")) & (F.col(rank) < F.col("run_to"))
    within = F.col(rank) - F.col("run_from")
    return ranked.join(table, here, "left").select(
        *[F.col(f"`{c}`") for c in ranked.columns if c != rank],
        (F.col("first_bin") + F.expr(f"(`{rank}` - run_from) div per_bin")).alias("sequence_id"),
        (F.col("place") + within % F.col("per_bin") * F.col(length)).alias("offset"),
    )


def token_pieces(
    df: DataFrame, text: str, tokenizer_path: str, ranks_path: str | None, pattern: str, end_id: int, capacity: int
) -> DataFrame:
    """One row per piece: the other columns, ``piece``, ``start``, ``length`` and ``ids`` (little-endian uint32).

    Texts of more than ``capacity`` ids, the end id included, are cut from the end, so
    only the first piece can be shorter.
    """
    kept = [c for c in df.columns if c.lower() not in (text.lower(), "piece", "start", "length", "ids")]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(fresh(df, "text_to_encode")))
    width = len(kept)
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:width]] + [PIECE_SCHEMA])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path, pattern).encode
        for batch in batches:
            rows, held = [], 0
            for i, value in enumerate(batch.column(width)):
                blob = encode(value.as_py() or "") + end
                total = len(blob) // 4
                begin = 0
                stop = (total - 1) % capacity + 1
                piece = 0
                while begin < total:
                    rows.append((i, piece, begin, stop - begin, blob[begin * 4 : stop * 4]))
                    piece, begin, stop = piece + 1, stop, stop + capacity
                held += len(blob)
                if held > 2 << 20:
                    yield pieces_of(batch, rows)
                    rows, held = [], 0
            if rows:
                yield pieces_of(batch, rows)

    def pieces_of(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        row, piece, start, length, ids = zip(*rows)
        taken = batch.take(pa.array(row, pa.int64()))
        added = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays([*taken.columns[:width], *added], names=[*kept, "piece", "start", "length", "ids"])

    return source.mapInArrow(cut, fields)
