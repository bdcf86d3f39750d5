"""Full outer joins over chains of tables, and the two access look-ups."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.functions.columns import all_of, col, require
from rinseframe.plans.lineage import cut_lineage, shuffle_partitions

# Bytes of a table, as JSON text, that may be sent whole to every task of an unconditional join.
BROADCAST_BYTES = 8 << 20
# Pairs of rows for each cell of the grid of an unconditional join.
CELL_PAIRS = 1 << 28
# Frequent keys looked for on each side, and keys a sketch follows at once.
MOST_HOT, FOLLOWED = 100, 8192
# Rows of a key from which on it is joined apart, and cells for each partition its rows would fill.
HOT_ROWS = 100_000
HOT_CELLS = 2


def _null_row(df: DataFrame) -> list:
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]


def _complete(names: list[str]) -> Column:
    return all_of(col(n).isNotNull() for n in names)


def _keys(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct non-null key tuples under neutral names, reduced before the shuffle."""
    return df.where(_complete(names)).select(*[col(n).alias(f"_k{i}") for i, n in enumerate(names)]).distinct()


def _among(df: DataFrame, names: list[str], keys: DataFrame, how: str) -> DataFrame:
    """Rows whose key does (left_semi) or does not (left_anti) occur in ``keys``."""
    return df.join(keys, all_of(col(n) == F.col(f"_k{i}") for i, n in enumerate(names)), how)


def hot_keys(df: DataFrame, names: list[str], least_rows: int) -> DataFrame:
    """Keys with at least so many rows, for the ``hot`` argument of ``full_join``."""
    counted = df.where(_complete(names)).groupBy(*[col(n).alias(f"_k{i}") for i, n in enumerate(names)])
    return counted.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_rows).drop("_n")


def full_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], hot: DataFrame | None = None) -> DataFrame:
    """FULL OUTER join on equal column pairs; both sides keep their key columns.

    Rows with an empty key have no partner: they skip the join, which would send all of
    them to one task. Spark cannot split a key in a full outer join either, so rows of the
    keys in ``hot`` (see ``hot_keys``) are joined apart, as matches and rows without
    partner, where it can.
    """
    left_names, right_names = [a for a, _ in pairs], [b for _, b in pairs]
    same = all_of(col(a) == col(b) for a, b in pairs)
    whole_left, whole_right = left.where(_complete(left_names)), right.where(_complete(right_names))
    parts = [
        left.where(~_complete(left_names)).select("*", *_null_row(right)),
        right.where(~_complete(right_names)).select(*_null_row(left), "*"),
    ]
    if hot is not None:
        hot = cut_lineage(hot)
        hot_left, hot_right = (_among(d, n, hot, "left_semi") for d, n in ((whole_left, left_names), (whole_right, right_names)))
        parts += [
            hot_left.join(hot_right, same, "inner"),
            _among(hot_left, left_names, _keys(hot_right, right_names), "left_anti").select("*", *_null_row(right)),
            _among(hot_right, right_names, _keys(hot_left, left_names), "left_anti").select(*_null_row(left), "*"),
        ]
        whole_left, whole_right = (_among(d, n, hot, "left_anti") for d, n in ((whole_left, left_names), (whole_right, right_names)))
    result = whole_left.join(whole_right, same, "full")
    for part in parts:
        result = result.union(part)
    return result


def _key_hashes(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> tuple[Column, Column] | None:
    """Equal hashes of keys that are equal; None where a pair of types is compared in a type of its own."""

    def comparable(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, T.IntegralType):
            return col(name).cast("bigint")
        return col(name) + F.lit(0.0) if isinstance(kind, (T.FloatType, T.DoubleType)) else col(name)  # -0.0 equals 0.0

    sides = []
    for a, b in pairs:
        kinds = left.schema[a].dataType, right.schema[b].dataType
        if kinds[0] != kinds[1] and not all(isinstance(k, T.IntegralType) for k in kinds):
            return None
        sides.append((comparable(a, kinds[0]), comparable(b, kinds[1])))
    return F.xxhash64(*[a for a, _ in sides]), F.xxhash64(*[b for _, b in sides])


def _frequent(df: DataFrame, names: list[str], key: Column) -> tuple[int, dict[int, int]]:
    """Rows with a whole key, and the most frequent keys' rows, from a sketch that tasks merge."""
    hashed = df.where(_complete(names)).select(key.alias("_h"))
    row = hashed.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {MOST_HOT}, {FOLLOWED})").alias("top")).first()
    return row["n"], {item["item"]: item["count"] for item in row["top"] or []}


def hot_cells(
    left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], least_rows: int = HOT_ROWS
) -> list[tuple[int, int, int]]:
    """(key hash, parts of the left rows, parts of the right rows) of keys that would overfill a partition.

    At most ``MOST_HOT`` keys of each side, found by one frequent-items sketch a side.
    """
    hashes = _key_hashes(left, right, pairs)
    if hashes is None:
        return []
    sides = []
    for df, names, key in ((left, [a for a, _ in pairs], hashes[0]), (right, [b for _, b in pairs], hashes[1])):
        total, top = _frequent(df, names, key)
        sides.append((max(least_rows, total // shuffle_partitions(df.sparkSession)), top))
    (of_left, left_top), (of_right, right_top) = sides
    hot = {h for of_side, top in sides for h, n in top.items() if n >= 2 * of_side}

    def parts(rows: int, of_side: int) -> int:
        return ceil(HOT_CELLS * rows / of_side) if rows > of_side else 1

    return [(h, parts(left_top.get(h, 0), of_left), parts(right_top.get(h, 0), of_right)) for h in sorted(hot)]


def split_full_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], least_rows: int = HOT_ROWS) -> DataFrame:
    """``full_join`` that finds hot keys by itself and deals their pairs over a grid of cells.

    The rows of a hot key are numbered; left rows are cut by their number into the parts of one
    side of the grid and copied along the other, right rows the other way round, so every
    pair meets in one cell and no task holds a whole key.
    """
    cells = hot_cells(left, right, pairs, least_rows)
    if not cells:
        return full_join(left, right, pairs)
    left_names, right_names = [a for a, _ in pairs], [b for _, b in pairs]
    hashes = _key_hashes(left, right, pairs)
    hot = [h for h, _, _ in cells]
    grid = left.sparkSession.createDataFrame(cells, "_cell_h long, _left_parts int, _right_parts int")

    def parted(df: DataFrame, names: list[str], key: Column) -> tuple[DataFrame, DataFrame]:
        is_hot = _complete(names) & key.isin(hot)
        return df.where(~F.coalesce(is_hot, F.lit(False))), df.where(is_hot).withColumn("_hot", key)

    cold_left, hot_left = parted(left, left_names, hashes[0])
    cold_right, hot_right = parted(right, right_names, hashes[1])
    # stored, so that a row keeps its number when a task is repeated
    hot_left, hot_right = (cut_lineage(d.withColumn("_n", F.monotonically_increasing_id())) for d in (hot_left, hot_right))

    def in_cells(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        # at most 2 * MOST_HOT rows
        known = df.join(F.broadcast(grid), F.col("_hot") == F.col("_cell_h"))
        part = F.pmod(F.xxhash64("_n"), F.col(own)).cast("int").alias(names[0])
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1])
        return known.select(*[col(c) for c in df.columns if c not in ("_hot", "_n")], part, copies)

    x = in_cells(hot_left, "_left_parts", "_right_parts", ("_i", "_j"))
    y = in_cells(hot_right, "_right_parts", "_left_parts", ("_q", "_p"))
    same = all_of(col(a) == col(b) for a, b in pairs) & (F.col("_i") == F.col("_p")) & (F.col("_j") == F.col("_q"))
    columns = [col(c) for c in left.columns + right.columns]
    met = x.join(y, same).select(*columns)
    lone_left = _among(hot_left, left_names, F.broadcast(_keys(hot_right, right_names)), "left_anti").drop("_hot", "_n")
    lone_right = _among(hot_right, right_names, F.broadcast(_keys(hot_left, left_names)), "left_anti").drop("_hot", "_n")
    return (
        full_join(cold_left, cold_right, pairs)
        .union(met)
        .union(lone_left.select("*", *_null_row(right)))
        .union(lone_right.select(*_null_row(left), "*"))
    )


def _bytes(df: DataFrame) -> int:
    """Size of a table as JSON text, in one pass with partial sums."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def grid_sides(left_rows: int, right_rows: int, cells: int) -> tuple[int, int]:
    """Parts of the left and of the right rows: about so many cells, with the fewest copies of rows in all."""
    left_parts = min(max(1, round(sqrt(cells * left_rows / right_rows))), cells, left_rows)
    return left_parts, min(max(1, ceil(cells / left_parts)), right_rows)


def full_join_unconditional(left: DataFrame, right: DataFrame) -> DataFrame:
    """FULL OUTER join without a condition: every pair, or the other side if one is empty.

    All pairs are the result here, so the work cannot be less than that. A side of
    proven small size is broadcast; otherwise both sides are dealt into parts that meet
    in the cells of a grid, so rows are copied about twice the root of cells times pairs.
    """
    if right.isEmpty():
        return left.select("*", *_null_row(right))
    if left.isEmpty():
        return right.select(*_null_row(left), "*")
    columns = [col(n) for n in left.columns + right.columns]
    for small, big in ((right, left), (left, right)):
        if _bytes(small) <= BROADCAST_BYTES:
            return big.join(F.broadcast(small), F.lit(True), "inner").select(*columns)
    # numbered and stored, so that a row keeps its number when a task is repeated
    sides = [cut_lineage(d.withColumn("_n", F.monotonically_increasing_id())) for d in (left, right)]
    counts = [d.count() for d in sides]
    cells = max(shuffle_partitions(left.sparkSession), ceil(counts[0] * counts[1] / CELL_PAIRS))
    parts = grid_sides(*counts, cells)

    def in_cells(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        part = F.pmod(F.xxhash64("_n"), F.lit(own)).alias(names[0])
        copies = F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1])
        return df.select(*[col(c) for c in df.columns if c != "_n"], part, copies)

    x, y = in_cells(sides[0], *parts, ("_i", "_j")), in_cells(sides[1], *parts[::-1], ("_q", "_p"))
    return x.join(y, (F.col("_i") == F.col("_p")) & (F.col("_j") == F.col("_q"))).select(*columns)


def join_tables(
    tables: dict[str, DataFrame], *matches: list[str | None], cross: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Full outer join of a chain of tables, each with the next one.

    Every match lists one column per table, or None to leave a table out of that
    match. Neighbours without a common match are an error, unless ``cross`` asks for
    every pair of their rows. Result columns are named ``table.column``. Keys of ``hot_rows``
    rows or more that would overfill a partition are split.
    """
    names = list(tables)
    for match in matches:
        if not isinstance(match, (list, tuple)) or len(match) != len(names):
            raise ValueError("a match needs one column, or None, per table")
        for table, column in zip(names, match):
            if column is not None:
                require(tables[table], column)
    labelled = {
        t: df.select(*[col(c).alias(f"{t}.{c}") for c in df.columns]) for t, df in tables.items()
    }

    result = labelled[names[0]]
    for i in range(len(names) - 1):
        here, there = names[i], names[i + 1]
        pairs = [
            (f"{here}.{m[i]}", f"{there}.{m[i + 1]}") for m in matches if m[i] is not None and m[i + 1] is not None
        ]
        if not pairs and not cross:
            raise ValueError(f"no match joins {here!r} and {there!r}; cross=True asks for every pair of their rows")
        if i > 0:  # the intermediate result is read by several branches: compute it once
            result = cut_lineage(result)
        there = labelled[there]
        result = split_full_join(result, there, pairs, hot_rows) if pairs else full_join_unconditional(result, there)
    return result


def join_two(
    tables: dict[str, DataFrame], left: str, right: str, left_columns: list[str], right_columns: list[str], name: str
) -> dict[str, DataFrame]:
    """Join two of the tables; the result takes their place under ``name``."""
    if len(left_columns) != len(right_columns):
        raise ValueError("as many left as right columns are needed")
    matches = [list(pair) for pair in zip(left_columns, right_columns)]
    joined = join_tables({left: tables[left], right: tables[right]}, *matches)
    return {**{t: df for t, df in tables.items() if t not in (left, right)}, name: joined}


def holders(users: DataFrame, user_roles: DataFrame, on: tuple[str, str], role: str, value) -> DataFrame:
    """Users for whom a row with the given role exists."""
    granted = user_roles.where(col(role) == F.lit(value)).select(col(on[1]).alias("_holder")).distinct()
    return users.join(granted, col(on[0]) == F.col("_holder"), "left_semi")


def accessible(datasets: DataFrame, roles: DataFrame, held: DataFrame, access: tuple[str, str], held_role: str) -> DataFrame:
    """Datasets joined with their role, where that role is among the held ones."""
    held_roles = held.select(col(held_role).alias("_held")).distinct()
    joined = datasets.join(roles, col(access[0]) == col(access[1]), "inner")
    return joined.join(held_roles, col(access[1]) == F.col("_held"), "left_semi")

