"""Records that span the places where a text file was cut.

A file is split freely among tasks at every separator, also at those inside quotes. What
a separator means depends on all text before it, so a first pass finds, for each state a
file block may begin in, the state it ends in. These tables of states are composed over runs
of neighbouring blocks, the runs are followed from the start of the file, and within each
run the blocks, which gives every block's first state. A second pass puts the pieces together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseframe.plans.lineage import cut_lineage

#: bytes of neighbouring blocks whose tables are composed in one task
RUN_BYTES = 128 << 30
#: rows of block states that are broadcast, about 200 bytes each; more are joined by a shuffle
FEW_BLOCKS = 100_000
#: outside everything: a separator met in this state ends a record
CODE = 0
INHERITED = -1
#: (piece, state, whether the text is wanted) -> state after it, the text to keep
Step = Callable[[str, int, bool], tuple[int, str]]


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, value): the pieces of text files, in order within each file block."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def rejoin(
    pieces: DataFrame,
    step: Step,
    states: int,
    separator: str,
    may_end_in: tuple[int, ...] = (CODE,),
    left_out: tuple[int, ...] = (),
) -> DataFrame:
    """(record, first): the records of the pieces, and whether it is the first of its file.

    Separators met in the states ``left_out`` do not belong to the record. A file that ends
    in a state other than ``may_end_in`` is an error.
    """

    def transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per block and possible first state: the last state, and whether a record ends in between."""
        done, here, ends, cuts = [], None, [], []
        for batch in batches:
            for file, block, value in zip(batch["file"], batch["block"], batch["value"]):
                if (file, block) != here:
                    if here:
                        done.append((*here, ends, cuts))
                    here, ends, cuts = (file, block), list(range(states)), [False] * states
                known: dict[int, int] = {}
                for first in range(states) if block else (CODE,):  # a file begins outside everything
                    if ends[first] not in known:
                        known[ends[first]] = step(value, ends[first], False)[0]
                    ends[first] = known[ends[first]]
                    cuts[first] |= ends[first] == CODE
        if here:
            done.append((*here, ends, cuts))
        yield pd.DataFrame(done, columns=["file", "block", "ends", "cuts"])

    def walk(blocks: pd.DataFrame, state: int, origin: int) -> tuple[int, int, list[tuple[int, int]]]:
        """Last state, block in which the record open then began, and both at the start of each block."""
        before = []
        for block in blocks.itertuples():
            before.append((state, origin))
            if state == CODE or block.cuts[state]:
                origin = block.block
            state = int(block.ends[state])
        return state, origin, before

    def compose(blocks: pd.DataFrame) -> pd.DataFrame:
        """A run of blocks as one table; a record open since before the run has no origin yet."""
        blocks = blocks.sort_values("block")
        found = [walk(blocks, first, INHERITED)[:2] for first in range(states)]
        one = [[end for end, _ in found], [origin for _, origin in found]]
        return pd.DataFrame([(blocks["file"].iloc[0], blocks["run"].iloc[0], *one)], columns=["file", "run", "ends", "origins"])

    def follow(runs: pd.DataFrame) -> pd.DataFrame:
        """Each run's first state, and the block in which the record open there began."""
        rows, state, origin = [], CODE, INHERITED
        for run in runs.sort_values("run").itertuples():
            rows.append((run.file, run.run, state, origin))
            began = int(run.origins[state])
            origin, state = origin if began == INHERITED else began, int(run.ends[state])
        if state not in may_end_in:
            raise ValueError(f"a quote or comment is left open at the end of {runs['file'].iloc[0]}")
        return pd.DataFrame(rows, columns=["in_file", "in_run", "begins", "origin"])

    def expand(blocks: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        """The blocks of a run that begin inside something."""
        blocks = blocks.sort_values("block")
        _, _, before = walk(blocks, int(first["begins"].iloc[0]), int(first["origin"].iloc[0]))
        rows = [(b.file, b.block, state, origin) for b, (state, origin) in zip(blocks.itertuples(), before) if state != CODE]
        return pd.DataFrame(rows, columns=["in_file", "in_block", "begins", "origin"])

    columns = ["file", "origin", "block", "first", "record"]

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole records (no file), and parts of those that go on in or come from another block."""
        here, state, parts, origin, first = None, CODE, [], None, False

        def rest() -> tuple:
            return here[0], here[1] if origin is None else origin, here[1], first, "".join(parts)

        for batch in batches:
            found = []
            for file, block, begins, came_from, value in zip(*(batch[c] for c in ("file", "block", "begins", "origin", "value"))):
                if (file, block) != here:
                    if parts:
                        found.append(rest())
                    here, state, parts, first = (file, block), CODE if pd.isna(begins) else int(begins), [], block == 0
                    origin = None if pd.isna(came_from) else int(came_from)
                state, kept = step(value, state, True)
                parts.append(kept if state == CODE or state in left_out else kept + separator)
                if state == CODE:
                    found.append((file if origin is not None else None, origin, block, first, "".join(parts)))
                    parts, origin, first = [], None, False
            yield pd.DataFrame(found, columns=columns).astype({"origin": "Int64"})
        if parts:
            yield pd.DataFrame([rest()], columns=columns).astype({"origin": "Int64"})

    blocks = pieces.mapInPandas(transitions, "file string, block long, ends array<int>, cuts array<boolean>")
    blocks = cut_lineage(blocks.withColumn("run", F.expr(f"block div {RUN_BYTES}")))
    runs = blocks.groupBy("file", "run").applyInPandas(compose, "file string, run long, ends array<int>, origins array<long>")
    firsts = runs.groupBy("file").applyInPandas(follow, "in_file string, in_run long, begins int, origin long")
    begins = cut_lineage(
        blocks.groupBy("file", "run")
        .cogroup(firsts.groupBy("in_file", "in_run"))
        .applyInPandas(expand, "in_file string, in_block long, begins int, origin long")
    )
    same = (F.col("file") == F.col("in_file")) & (F.col("block") == F.col("in_block"))
    if begins.count() <= FEW_BLOCKS:
        known = pieces.join(F.broadcast(begins), same, "left")
    else:  # a shuffle loses the order of pieces
        at = pieces.withColumn("at", F.monotonically_increasing_id())
        known = at.join(begins, same, "left").sortWithinPartitions("file", "block", "at")
    known = known.select("file", "block", "begins", "origin", "value")
    put = cut_lineage(known.mapInPandas(put_together, "file string, origin long, block long, first boolean, record string"))
    parts = F.array_sort(F.collect_list(F.struct("block", "record")))
    glued = put.where("file IS NOT NULL").groupBy("file", "origin").agg(
        F.array_join(F.transform(parts, lambda p: p["record"]), "").alias("record"), F.bool_or("first").alias("first")
    )
    return put.where("file IS NULL").select("record", "first").unionByName(glued.select("record", "first"))
