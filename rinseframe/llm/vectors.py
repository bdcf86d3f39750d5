"""All pairs of vectors above a cosine, exactly: a metric range join around pivots.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Every
vector's home cell is that of its nearest pivot. A vector x can have a partner at home in
cell i only if x lies within r of that cell, which is certain not to be the case when

* d(x, p_i) > R_i + r, where R_i is the largest distance of a member of cell i to p_i, or
* d(x, p_i) - d(x, p_home) > 2r, or x is farther than r from the plane halfway between p_i
  and the home pivot, on whose other side all members of cell i are (both by the triangle
  inequality).

Otherwise x is copied into cell i. A member then has all its partners in its home cell, so
cells join independently and every link is found in the home cells of both ends. Cells are
cut into blocks of bounded size, and a task joins one block of members with one block of
members and copies, as one matrix product in double precision.

Pivots come from a bounded sample (``SAMPLE`` vectors of smallest hash, spread by farthest
point); they decide the cost and never the result. Equal vectors are one point with a count.
Of a block's links only their number per member and a spanning forest leave the task.

Defined results: vectors that are null, zero, or hold null or non-finite components link
with nothing; vectors of different lengths do not link; a repeated row is another vector;
rows with null ids link with nothing and are kept; an empty table stays empty; input columns
named like an added column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.llm.components import components, labelled
from rinseframe.llm.frames import Scratch, all_equal, fresh, without

SAMPLE = 4096
MOST_PIVOTS = 512
#: points for each pivot, and rows of a block
CELL_POINTS, BLOCK_ROWS = 4096, 4096
#: rows of a block multiplied at once
STRIP = 256
#: added to distances when cells are chosen, so rounding never loses a copy
SLACK = 1e-6


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Blobs of equally many numbers as rows of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)


def units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def points(vectors: DataFrame, kind: str) -> DataFrame:
    """(id, key, dim, vector blob) of each (id, embedding, key) row; null where the vector links with nothing."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, blobs = [], []
            for value in batch.column(1):
                row = value.values.to_numpy(zero_copy_only=False).astype(kind) if value.is_valid else None  # null is NaN
                good = row is not None and len(row) > 0 and np.isfinite(row).all() and row.any()
                dims.append(len(row) if good else None)
                blobs.append((row + row.dtype.type(0)).tobytes() if good else None)  # -0.0 equals 0.0
            found = [pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], schema=schema)

    return vectors.mapInArrow(convert, "id long, key long, dim int, vector binary")


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots by farthest point first: each next one is the farthest from those chosen."""
    chosen = [0]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, 2 - 2 * sample @ sample[chosen[-1]])
        far = int(nearest.argmax())
        if nearest[far] <= SLACK:
            break
        chosen.append(far)
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def choose_pivots(classes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """For each dimension unit pivots, as many as its points ask for."""
    counts = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}
    sample = classes.select("dim", "vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toArrow()
    pivots = {}
    for dim, count in counts.items():
        rows = sample.column("vector").filter(pa.array(np.asarray(sample.column("dim")) == dim)).combine_chunks()
        wanted = min(MOST_PIVOTS, -(-count // CELL_POINTS))
        pivots[dim] = spread(units(matrix(rows, kind)), wanted) if len(rows) else np.eye(1, dim)
    return pivots


def by_dimension(batch: pa.RecordBatch, pivots: dict[int, np.ndarray], kind: str) -> Iterator[tuple]:
    """(rows, pivots, distances to them) for each dimension in the batch."""
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        chosen = pivots[int(dim)]
        yield rows, chosen, distances(units(matrix(batch.column("vector").take(pa.array(rows)), kind)), chosen)


def with_home(classes: DataFrame, pivots: dict[int, np.ndarray], kind: str) -> DataFrame:
    """Add the nearest pivot and the distance to it."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for rows, _, d in by_dimension(batch, pivots, kind):
                home[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
            added = [pa.array(home), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "home", "far"])

    columns = classes.select("node", "dim", "vector", "copies")
    return columns.mapInArrow(nearest, "node long, dim int, vector binary, copies long, home int, far double")


def in_cells(homes: DataFrame, pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], float], radius: float, kind: str) -> DataFrame:
    """A row for each point and cell: its home cell, and those where it may have a partner."""

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, home = np.asarray(batch.column("dim")), np.asarray(batch.column("home"))
            for rows, chosen, d in by_dimension(batch, pivots, kind):
                dim = int(dims[rows[0]])
                own = np.arange(len(rows))
                nearest = d[own, home[rows]][:, None]
                apart = distances(chosen, chosen)[home[rows]]
                beyond = (d * d - nearest * nearest) > 2 * apart * radius + SLACK
                far = np.array([radii.get((dim, i), -1.0) for i in range(len(chosen))])
                near = (d <= far + radius + SLACK) & (d - nearest <= 2 * radius + SLACK) & ~beyond & (far >= 0)
                near[own, home[rows]] = True
                at, cell = np.nonzero(near)
                taken = batch.select(["node", "dim", "vector", "copies"]).take(pa.array(rows[at]))
                added = [pa.array(cell.astype(np.int32)), pa.array(cell == home[rows[at]])]
                yield pa.RecordBatch.from_arrays([*taken.columns, *added], names=[*taken.schema.names, "cell", "member"])

    return homes.mapInArrow(copied, "node long, dim int, vector binary, copies long, cell int, member boolean")


def block_rows(cells: DataFrame) -> DataFrame:
    """Each cell's rows dealt to its pairs of blocks: members (side 0) by members and copies (side 1)."""
    sizes = cells.groupBy("dim", "cell").agg(F.count_if("member").alias("members"), F.count("*").alias("points"))
    whole = F.lit(BLOCK_ROWS)
    blocks = sizes.select(
        "dim", "cell", F.ceil(F.col("members") / whole).alias("rows_of"), F.ceil(F.col("points") / whole).alias("columns_of")
    ).where("rows_of > 0")
    dealt = cells.join(blocks, ["dim", "cell"])
    own = F.xxhash64("node")
    data = ["dim", "cell", "node", "vector", "copies"]
    rows = dealt.where("member").select(
        *data, F.pmod(own, "rows_of").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns_of") - 1)).alias("b"), F.lit(0).alias("side")
    )
    columns = dealt.select(
        *data, F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows_of") - 1)).alias("a"), F.pmod(own, "columns_of").alias("b"), F.lit(1).alias("side")
    )
    return rows.unionByName(columns)


def block_links(cells: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(a, links, null) with the number of a member's links in a block, and (a, null, b) with forest edges."""
    schema = pa.schema([("a", pa.int64()), ("links", pa.int64()), ("b", pa.int64())])

    def join(block: pa.Table) -> pa.Table:
        side = np.asarray(block.column("side"))
        sides = []
        for s in (0, 1):
            part = block.filter(pa.array(side == s))
            vectors = matrix(part.column("vector").combine_chunks(), kind) if part.num_rows else np.empty((0, 1))
            scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True) if part.num_rows else vectors
            norms = np.sqrt((scaled * scaled).sum(axis=1))
            sides.append((np.asarray(part.column("node")), np.asarray(part.column("copies")), scaled, norms))
        (node_a, _, x, norm_x), (node_b, copies, y, norm_y) = sides
        if not len(node_a) or not len(node_b):
            return schema.empty_table()
        linked = np.empty((len(node_a), len(node_b)), dtype=bool)
        links = np.zeros(len(node_a), dtype=np.int64)
        for i in range(0, len(node_a), STRIP):
            strip = slice(i, i + STRIP)
            near = (x[strip] @ y.T) / (norm_x[strip, None] * norm_y[None, :]) >= cosine
            linked[strip] = near & (node_a[strip, None] != node_b[None, :])
            links[strip] = linked[strip] @ copies
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        nodes, labels = forest(linked[np.ix_(rows, columns)], node_a[rows], node_b[columns])
        some = np.flatnonzero(links)
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate([node_a[some], nodes])),
                pa.array(np.concatenate([links[some], np.zeros(len(nodes), dtype=np.int64)])),
                pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), labels]), mask=np.arange(len(some) + len(nodes)) < len(some)),
            ],
            schema=schema,
        )

    return block_rows(cells).groupBy("dim", "cell", "a", "b").applyInArrow(join, "a long, links long, b long")


def forest(linked: np.ndarray, node_a: np.ndarray, node_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the block's graph with the smallest node it reaches there, if that is another."""
    low_a, low_b = node_a.copy(), node_b.copy()
    most = np.iinfo(np.int64).max
    changed = bool(linked.size)
    while changed:
        before_a, before_b = low_a.copy(), low_b.copy()
        for i in range(0, len(low_a), STRIP):
            low_a[i : i + STRIP] = np.minimum(low_a[i : i + STRIP], np.where(linked[i : i + STRIP], low_b, most).min(axis=1))
        for i in range(0, len(low_a), STRIP):
            low_b = np.minimum(low_b, np.where(linked[i : i + STRIP], low_a[i : i + STRIP, None], most).min(axis=0))
        changed = not (np.array_equal(before_a, low_a) and np.array_equal(before_b, low_b))
    nodes, labels = np.concatenate([node_a, node_b]), np.concatenate([low_a, low_b])
    moved = nodes != labels
    return nodes[moved], labels[moved]


def similar_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Add ``n_links`` (other vectors at this cosine or above), ``component_id`` and ``kept``."""
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    df = without(df, "n_links", "component_id", "kept")
    scratch = Scratch(df.sparkSession)
    kind = "<f4" if df.schema[vector_col].dataType.elementType == T.FloatType() else "<f8"
    own_id, own_vector = F.col(f"`{id_col}`").cast("long"), F.col(f"`{vector_col}`")
    rows = scratch.stored(points(df.select(own_id.alias("id"), own_vector.alias("embedding"), F.xxhash64(own_vector).alias("key")), kind), "vectors")
    classes = rows.where("dim IS NOT NULL AND id IS NOT NULL").groupBy("dim", "vector")
    classes = classes.agg(F.min("id").alias("low_id"), F.count("*").alias("copies")).sort("low_id")
    classes = scratch.stored(classes.withColumn("node", F.monotonically_increasing_id()), "points")

    radius = math.sqrt(2 - 2 * cosine)
    pivots = choose_pivots(classes, kind)
    homes = scratch.stored(with_home(classes, pivots, kind), "homes")
    radii = {(r.dim, r.home): r.far for r in homes.groupBy("dim", "home").agg(F.max("far").alias("far")).collect()}
    cells = scratch.stored(in_cells(homes, pivots, radii, radius, kind), "cells")
    found = scratch.stored(block_links(cells, cosine, kind), "links")
    scratch.drop(homes, cells)
    roots = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))

    named = classes.select(F.col("node").alias("root"), F.col("low_id").alias("component_id"))
    judged = labelled(classes.select("node", "dim", "vector", "copies"), "node", roots, "root").join(named, "root").join(counts, "node", "left")
    judged = judged.select("dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    valid = F.col("id").isNotNull()
    matched = rows.select("id", "key", "dim", "vector").dropDuplicates(["id", "key"]).join(judged, ["dim", "vector"], "left")
    names = {c: fresh(df, f"found_{c}") for c in ("id", "key", "n_links", "component_id")}
    answers = {
        "id": F.col("id"),
        "key": F.col("key"),
        "n_links": F.when(valid, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long"),
        "component_id": F.when(valid, F.coalesce("component_id", "id")),
    }
    labels = scratch.stored(matched.select(*[answers[c].alias(n) for c, n in names.items()]), "labels")
    scratch.drop(rows, classes, found, roots)
    component = F.col(names["component_id"])
    return df.join(labels, all_equal([own_id, F.xxhash64(own_vector)], [F.col(names["id"]), F.col(names["key"])])).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col(names["n_links"]).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == own_id, F.lit(True)).alias("kept"),
    )
