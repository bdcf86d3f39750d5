"""Near-duplicate documents by MinHash with tensored banding.

A table key needs six minima to agree. Instead of six fresh hash functions per table, two
small collections of half keys (three minima each) are computed, and every pair (left half
i, right half j) forms a table key: at a similarity of 0.85, 13 + 13 half keys from 78
minima form 169 table keys, which would take 1014 minima one by one. Their number is set so
that a pair right at the similarity agrees in no table with probability ``MISSED`` at most.

Half keys that no other document has cannot form a shared table key and are dropped before
pairs are formed. Documents with equal shingle sets are one class from the start. Within a
table, members are compared with the table's smallest member first; what this links is one
component, and only members of different components that share a table are compared after
that, so large groups of copies cost no pair per pair of members. Where a table still holds
many members of different components (documents of one template, similar but not enough),
they are not compared with each other: they meet by prefixes of their sets instead, the
shingles that fewest of these members have. Two sets that reach the similarity share one of
them whatever the table, and a template's common shingles come last; under a shingle, too,
members are compared with the smallest one first, then across components. Every comparison first
passes an exact bound on the difference of the sets, from the odd-count bits of their
hashes, and is then confirmed on the full sets.

Defined results: null or wordless texts have an empty set and link with nothing; a text of
fewer words than a shingle is one shingle; rows with equal ids are judged by their own
texts; rows with null ids link with nothing and are kept; an empty table stays empty; input
columns named like an added column are replaced. ``one_of_each`` judges rows by a number of
their own, so rows with equal ids and rows with null ids are documents that link like all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinseframe.llm.components import components, labelled
from rinseframe.llm.fingerprints import LOWER, U64, batch_words, mixed, windows
from rinseframe.llm.frames import Scratch, all_equal, fresh, settings, with_rows, without

MINIMA = 3
MISSED = 2e-5
ODD_WORDS = 16
#: components in a table, above which its members meet by prefixes
CROWDED = 64
#: texts and sets meet ids in shuffled joins at every size, as they must on a large table
ALIKE = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
#: elements hashed at once by all functions
SLICE = 1 << 15
SKETCH = "id long, text_hash long, n long, set_a long, set_b long, lefts array<long>, rights array<long>, odd array<long>"


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle fingerprints, sorted within a text, and where each text's begin."""
    words, firsts = batch_words(column, LOWER)
    grams = windows(words, k)
    sets, ends = [], [0]
    for first, last in zip(firsts[:-1], firsts[1:]):
        n = last - first
        if n >= k:
            found = np.unique(grams[first : last - k + 1])
        elif n:
            whole = windows(words[first:last], int(n))
            found = whole ^ U64(n)  # apart from full shingles
        else:
            found = words[:0]
        sets.append(found)
        ends.append(ends[-1] + len(found))
    return (np.concatenate(sets) if sets else words[:0]), np.array(ends)


def minima(flat: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest value of each set (none empty) under each hash function: sets by functions."""
    n = len(ends) - 1
    result = np.empty((n, len(seeds)), dtype=U64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, side="right")) - 1)
        part, begins = flat[ends[i] : ends[j]], ends[i:j] - ends[i]
        for f, seed in enumerate(seeds):
            h = part ^ seed
            h *= U64(0x9FB21C651E98DF25)
            h ^= h >> U64(32)
            result[i:j, f] = np.minimum.reduceat(h, begins)
        i = j
    return result


def halves(percent: int) -> int:
    """Half keys of each side: a pair is missed if all of either side differ."""
    return math.ceil(math.log(MISSED / 2) / math.log(1 - (percent / 100) ** MINIMA)) if percent < 100 else 1


def half_keys(low: np.ndarray) -> np.ndarray:
    """Keys of three minima each, from the minima of one collection."""
    parts = low.reshape(len(low), -1, MINIMA)
    key = np.arange(parts.shape[1], dtype=U64)[None, :] + U64(1)
    for t in range(MINIMA):
        key = mixed(key * U64(0xD1342543DE82EF95) + parts[:, :, t])
    return key


def odd_bits(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each set the parity of the number of elements in each of 1024 cells, as 16 words."""
    n, cells = len(ends) - 1, ODD_WORDS * 64
    owner = np.repeat(np.arange(n), np.diff(ends))
    odd = np.zeros((n, cells), dtype=np.uint8)
    np.bitwise_xor.at(odd, (owner, (flat % U64(cells)).astype(np.int64)), 1)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def set_marks(flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """128 bits that stand for each set (none empty)."""
    return [np.add.reduceat(mixed(flat + U64(s)), ends[:-1]).view(np.int64) for s in (1, 2)]


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A sketch of each (id, text, text_hash) row."""
    schema = pa.schema(
        [("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64())]
        + [(c, pa.list_(pa.int64())) for c in ("lefts", "rights", "odd")]
    )
    split = halves(percent) * MINIMA
    seeds = mixed(np.arange(1, 2 * split + 1, dtype=U64) * U64(0xA0761D6478BD642F))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                flat, ends = shingle_sets(batch.column(1), k)
                sizes = np.diff(ends)
                has = np.flatnonzero(sizes)
                ends = np.append(ends[:-1][has], ends[-1])
                if not len(has):
                    batch_of = [pa.nulls(batch.num_rows, f.type) for f in schema][3:]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), *batch_of], schema=schema)
                    continue
                low = minima(flat, ends, seeds)
                marks = set_marks(flat, ends)
                lists = [half_keys(low[:, :split]).view(np.int64), half_keys(low[:, split:]).view(np.int64), odd_bits(flat, ends)]
                row = np.full(batch.num_rows, -1)
                row[has] = np.arange(len(has))
                index = pa.array(row, mask=row < 0)
                columns = [pa.array(m) for m in marks]
                columns += [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.int64())) for a in lists]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), *[c.take(index) for c in columns]], schema=schema)

    return docs.mapInArrow(sketch, SKETCH)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """The full shingle set of each (id, text) row that has one, as a blob of sorted fingerprints."""
    names = ["id", "n", "set_a", "set_b", "shingles"]

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                flat, ends = shingle_sets(batch.column(1), k)
                has = np.flatnonzero(np.diff(ends))
                if len(has):
                    ends = np.append(ends[:-1][has], ends[-1])
                    found = pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                    sizes, marks = pa.array(np.diff(ends)), [pa.array(m) for m in set_marks(flat, ends)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), sizes, *marks, found], names=names)

    return docs.mapInArrow(full, "id long, n long, set_a long, set_b long, shingles binary")


def may_link(percent: int, a: str, b: str) -> Column:
    """Whether the sets can reach the similarity: the odd bits in which they differ are differences of the sets.

    With s = |A| + |B|, percent * |A or B| <= 100 * |A and B| bounds the difference by s * (100 - p) / (100 + p).
    """
    differing = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(ODD_WORDS)), F.lit(0))
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    smaller, larger = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * smaller >= percent * larger) & ((100 + percent) * differing <= (100 - percent) * total)


def table_members(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, center) of every table key that two classes share at least; the center is its smallest node."""
    listed = classes.select("node", F.posexplode(F.array("lefts", "rights")).alias("side", "keys"))
    half = listed.select("node", "side", F.posexplode("keys").alias("half", "value"))
    often = half.groupBy("side", "half", "value").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = half.join(often.where("low < high").select("side", "half", "value"), ["side", "half", "value"])
    entry = F.struct("half", "value")
    by_node = shared.groupBy("node").agg(
        F.collect_list(F.when(F.col("side") == 0, entry)).alias("lefts"),
        F.collect_list(F.when(F.col("side") == 1, entry)).alias("rights"),
    )
    pairs = by_node.select("node", F.explode("lefts").alias("l"), "rights").select("node", "l", F.explode("rights").alias("r"))
    keys = scratch.stored(pairs.select("node", F.xxhash64("l.half", "l.value", "r.half", "r.value").alias("key")), "keys")
    tables = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last")
    found = scratch.stored(keys.join(tables.select("key", "center"), "key"), "tables")
    scratch.drop(keys)
    return found


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_of_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_of_a", "set_of_b")

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_of_a"], batch["set_of_b"]):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[keep, ["a", "b"]]

    return both.mapInPandas(similar, "a long, b long")


def prefixes(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, node) of the prefixes of some nodes' sets, without shingles that one node alone has.

    Shingles are ordered by how many of these nodes have them. Of a set of n, the rarest
    n - ceil(n * percent / 100) + 1 are its prefix: two sets that reach the similarity have
    more in common than either has outside its prefix.
    """
    names = ["node", "n", "shingle"]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(blob, np.int64)
                whole = [pa.array(np.full(len(found), v, dtype=np.int64)) for v in (node, len(found))]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(found)], names=names)

    of_crowd = sets.join(crowd.select("node"), "node", "left_semi").select("node", "shingles")
    listed = of_crowd.mapInArrow(opened, "node long, n long, shingle long")
    often = listed.groupBy("shingle").agg(F.count("*").alias("nodes"))
    # a shingle that one node has is in no other prefix, but takes its place in its own
    rank = F.row_number().over(Window.partitionBy("node").orderBy("nodes", "shingle"))
    ranked = listed.join(often, "shingle").select(*names, "nodes", rank.alias("rank"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.where((F.col("rank") <= length) & (F.col("nodes") > 1)).select("shingle", "node")


def centered(members: DataFrame, crowd: DataFrame) -> DataFrame:
    """(a, b): each (shingle, node) member with the smallest node of its shingle, where their roots differ."""
    least = members.groupBy("shingle").agg(F.min("node").alias("b"))
    pairs = members.join(least, "shingle").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    sides = [crowd.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").where("root_a <> root_b").select("a", "b")


def across_roots(members: DataFrame, roots: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of a shingle that are in different components, where their sets may reach the similarity."""
    owned = labelled(members, "node", roots, "root")
    split = owned.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    sided = owned.join(split.select("shingle"), "shingle").join(bounds, "node")
    x, y = sided.alias("x"), sided.alias("y")
    across = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    found = x.join(y, across & may_link(percent, "x", "y"))
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def linked(classes: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, root) stars over the classes."""
    members = table_members(classes, scratch)
    used = members.select("node").distinct()
    used = scratch.stored(classes.join(used, "node", "left_semi").select("node", "low_id", "n", "set_a", "set_b", "odd"), "used")
    texts = docs.join(used.select(F.col("low_id").alias("id")).distinct(), "id", "left_semi")
    same = ["low_id", "n", "set_a", "set_b"]
    sets = sets_of(texts, k).withColumnRenamed("id", "low_id").join(used.select("node", *same), same)
    spark = classes.sparkSession
    with settings(spark, ALIKE):
        sets = scratch.stored(sets.select("node", "shingles").dropDuplicates(["node"]), "sets")
    bounds = used.select("node", "n", "odd")

    def linked_of(pairs: DataFrame) -> DataFrame:
        with settings(spark, ALIKE):
            return scratch.stored(confirmed(pairs, sets, percent), "links")

    def checked(pairs: DataFrame) -> DataFrame:
        sides = [bounds.select(F.col("node").alias(c), F.struct("n", "odd").alias(f"side_{c}")) for c in "ab"]
        near = pairs.join(sides[0], "a").join(sides[1], "b").where(may_link(percent, "side_a", "side_b"))
        return linked_of(near.select("a", "b"))

    stars = members.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    stars = scratch.stored(stars, "candidates")
    nearest = stars.groupBy("a").agg(F.min("b").alias("b"))
    links = checked(nearest)
    first_roots = components(links, scratch)

    other = labelled(labelled(stars, "a", first_roots, "root_a"), "b", first_roots, "root_b").where("root_a <> root_b")
    more = checked(other.select("a", "b").join(nearest, ["a", "b"], "left_anti"))
    more_roots = components(links.union(more), scratch)

    owned = labelled(members, "node", more_roots, "root")
    split = owned.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    apart = scratch.stored(owned.join(split.select("key"), "key").join(bounds, "node"), "apart")
    full = apart.groupBy("key").agg(F.count_distinct("root").alias("roots")).where(F.col("roots") > CROWDED).select("key")
    full = scratch.stored(full, "crowded")
    few = apart.join(full, "key", "left_anti")
    x, y = few.alias("x"), few.alias("y")
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    across = across & (F.col("x.node") != F.col("y.center")) & may_link(percent, "x", "y")
    rest = x.join(y, across).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    if not full.isEmpty():
        crowd = scratch.stored(apart.join(full, "key", "left_semi").select("node", "root").distinct(), "crowd")
        under = scratch.stored(prefixes(crowd, sets, percent), "prefixes")
        more = more.union(checked(centered(under, crowd)))
        rest = rest.union(across_roots(under, components(links.union(more), scratch), bounds, percent))
    last = linked_of(rest.distinct())
    roots = components(links.union(more).union(last), scratch)
    scratch.drop(members, used, sets, stars, apart, full, links, more, last, first_roots, more_roots)
    return roots


def labels(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Store (id, text_hash, component_id, n) of the different (id, text_hash) of (id, text, text_hash) rows."""
    sketched = scratch.stored(sketches(docs, k, percent), "sketches")
    one = ["n", "set_a", "set_b"]
    classes = (
        sketched.where("n > 0 AND id IS NOT NULL")
        .groupBy(*one)
        .agg(F.min("id").alias("low_id"), *[F.first(c).alias(c) for c in ("lefts", "rights", "odd")])
        .sort("low_id")  # so that node numbers rise with the smallest id
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = scratch.stored(classes, "classes")
    roots = linked(classes, docs.drop("text_hash"), k, percent, scratch)

    named = classes.select(F.col("node").alias("root"), F.col("low_id").alias("component_id"))
    of_class = labelled(classes.select("node", *one), "node", roots, "root").join(named, "root").select(*one, "component_id")
    rows = sketched.select("id", "text_hash", *one).dropDuplicates(["id", "text_hash"]).join(of_class, one, "left")
    found = scratch.stored(rows.select("id", "text_hash", "component_id", "n"), "labels")
    scratch.drop(sketched, classes, roots)
    return found


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """Add ``n_shingles``, ``component_id`` and ``kept`` to each row.

    Two documents link where 100 * |A and B| >= percent * |A or B| over their sets of ``k``-word
    shingles, A-Z lower-cased; a component is what links reach, named by its smallest id.
    """
    df = without(df, "n_shingles", "component_id", "kept")
    own_id = F.col(f"`{id_col}`").cast("long")
    own_text = F.xxhash64(F.col(f"`{text_col}`"))
    docs = df.select(own_id.alias("id"), F.col(f"`{text_col}`").alias("text"), own_text.alias("text_hash"))
    names = {c: fresh(df, f"found_{c}") for c in ("id", "text_hash", "component_id", "n")}
    found = labels(docs, k, percent, Scratch(df.sparkSession)).select(*[F.col(c).alias(n) for c, n in names.items()])
    component = F.when(own_id.isNotNull(), F.coalesce(F.col(names["component_id"]), own_id))
    return df.join(found, all_equal([own_id, own_text], [F.col(names["id"]), F.col(names["text_hash"])])).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col(names["n"]).alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == own_id, F.lit(True)).alias("kept"),
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest id, rows without id last, then the first row.

    The rows are stored under a number, which stands for their id, so equal ids and null ids
    are rows of their own, and the ids only decide which row stays.
    """
    scratch = Scratch(df.sparkSession)
    row = fresh(df, "row")
    rows = with_rows(df, scratch, row)
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    own = F.col(row)
    found = labels(rows.select(own.alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash")), k, percent, scratch)
    ids = rows.select(own.alias("id"), F.col(row).alias("row"), doc_id.alias("doc_id"))
    component = F.coalesce("component_id", "id")
    first = F.min(F.struct(F.isnull("doc_id").alias("without"), "doc_id", "row"))["row"]
    best = found.select("id", component.alias("component_id")).join(ids, "id").groupBy("component_id").agg(first.alias("best"))
    best = scratch.stored(best.select("best"), "best")
    scratch.drop(found)
    return rows.join(best, F.col(row) == F.col("best"), "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
