"""Near-duplicate strings by edit distance, and their replacement.

Pairs within edit distance k are found by equi-joins on blocking keys that miss
none of them; a bounded Levenshtein check on the joined rows then removes the
false ones. There is no cross join and no cap on candidates. A pair is found
through its shorter string (by text among equal lengths), in one of five ways:

* Pieces: cut the string into more than k pieces. k edits leave at least one of any
  k+1 pieces whole, and it occurs in the longer string shifted by at most k. Kept
  as keys are the k+1 pieces that fewest strings share.
* Three pieces: k edits leave at least three of any k+3 pieces whole. Strings whose
  pieces are shared by many others (a template with a running number) are cut finer, so
  that their own part falls into pieces of its own; kept are the k+3 pieces that fewest
  share, and a key is three of them together, shifted by no more than k edits can.
* Long texts: their pieces are cut alike for all lengths of a step, and a piece's key is the least hash
  of the passages in it. So the longer string looks up a few keys a piece, whatever k is, and
  not one for each difference of lengths and each shift.
* Templates: strings whose pieces are crowded and that are equal but for their digits, or
  have both ends in common, are a group. What all of a group begin and end with is taken
  out, which changes no distance within it, and the rests meet by variants in which each edit
  is spelled: a place left open in both, or a character deleted from one. Two rests that
  share a variant are within the distance, so candidates follow the result. Pieces are
  then needed only between strings of different groups.
* Deletion variants: both strings have a common text left after deleting at most k
  characters from each. How many strings share a variant is bounded by the
  alphabet, not by the table, but a string has many of them. They serve strings
  too short for pieces, and strings whose pieces are all shared by so many others
  that variants are fewer than candidates.

For a large k, where even short strings have too many variants, strings of up to k
characters are paired directly: all pairs of them belong to the result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinseframe.functions import windows
from rinseframe.functions.columns import col, is_string, replace_columns, require
from rinseframe.plans.lineage import cut_lineage, remove_stored, shuffle_partitions, stored

# Deletion variants one string may have, and the longest string they are built for.
MAX_VARIANTS = 5000
MAX_VARIANT_LENGTH = 256
# Variants of all strings together below which no other keys are considered.
FEW_VARIANTS = 1_000_000
# Replacement maps given as dict are sent to every task up to this many bytes.
MAP_BYTES = 32 * 1024 * 1024
# Pieces cut per piece needed, and the least length of one.
SPARE_PIECES = 3
MIN_PIECE = 3
# Strings that share a string's rarest pieces, from which on three finer pieces are its keys.
CROWDED = 10
FINE_PIECE = 2
TOGETHER = 3
# Strings that make a template, the length of its ends where digits do not tell it, and variants a rest may have.
TEMPLATE_STRINGS = 10
TEMPLATE_ENDS = 16
TEMPLATE_VARIANTS = 2000
OPEN_PLACE = "\0"
# Bits for each key in the bitmap that tells look-ups without a partner, all of them at most, and words of a block.
# Up to ``FEW_KEYS`` keys are sent as they are.
KEY_BITS = 16
FEW_KEYS = 10_000
BITMAP_BITS = 1 << 28
BLOCK_WORDS = 512
# Look-ups of a string that are shuffled in one pass, on average, and the least number of all.
PASS_LOOK_UPS = 50
PASS_ROWS = 1_000_000
# Characters per partition below which strings are dealt out anew.
SPREAD_CHARACTERS = 1_000_000


def _variant_count(length: int, k: int) -> int:
    return sum(comb(length, i) for i in range(k + 1))


def _variant_limit(k: int) -> int:
    """Longest shorter string of a pair that variants can serve, 0 for none."""
    lengths = range(2 * k, MAX_VARIANT_LENGTH + 1)
    fitting = [partner - k for partner in lengths if _variant_count(partner, k) <= MAX_VARIANTS]
    return max(fitting, default=0)


def _direct_limit(k: int) -> int:
    """Longest string that has no more variants than a string may have look-ups for pieces."""
    fitting = [length for length in range(k, _variant_limit(k) + 1) if _variant_count(length, k) <= _look_up_count(k)]
    return max(fitting, default=k)


def distinct_values(df: DataFrame, column: str, order_col: str | None = None) -> DataFrame:
    """(v, n, f): each non-empty string, its occurrences and its first position.

    Without an order column strings are taken in their own order.
    """
    require(df, column)
    if order_col is not None:
        require(df, order_col)
    position = col(column) if order_col is None else col(order_col)
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("f"))
    )


def _deletion_variants(v: Column, k: int) -> Column:
    """Array of distinct strings left after deleting up to k characters."""

    def drop_one(s: Column) -> Column:
        positions = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
        return F.transform(positions, lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))

    level, variants = F.array(v), F.array(v)
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(level, drop_one)))
        variants = F.concat(variants, level)
    return F.array_distinct(variants)


def _string() -> Column:
    return F.struct("v", "n", "f").alias("s")


def _shorter(a: str, b: str) -> Column:
    """Whether a pair is found through its string ``a``."""
    a_length, b_length = F.length(f"{a}.v"), F.length(f"{b}.v")
    return (a_length < b_length) | ((a_length == b_length) & (F.col(f"{a}.v") < F.col(f"{b}.v")))


def _close(a: str, b: str, k: int) -> Column:
    return _shorter(a, b) & (F.levenshtein(f"{a}.v", f"{b}.v", k) >= 0)


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that goes by a shuffle.

    Rows made by ``explode`` and strings that compress well are many times what Spark expects
    from the size of the files, so a broadcast it chooses by itself can exceed the driver's memory.
    """
    return df.hint("merge")


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, h) tables as the two sides of a join on h."""
    return (
        left.select(F.col("s").alias("l"), F.col("h").alias("lh")),
        _shuffled(right.select(F.col("s").alias("r"), F.col("h").alias("rh"))),
    )


def _variant_pairs(shorter: DataFrame, values: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """Pairs found through ``shorter``, whose strings have the given lengths."""
    partners = sorted({length + d for length in lengths for d in range(k + 1)})

    def keyed(strings: DataFrame) -> DataFrame:
        variants = F.explode(_deletion_variants(F.col("v"), k)).alias("variant")
        return strings.select(_string(), variants).select("s", F.xxhash64("variant").alias("h"))

    left, right = _sides(keyed(shorter), keyed(values.where(F.length("v").isin(partners))))
    return left.join(right, (F.col("lh") == F.col("rh")) & _close("l", "r", k)).select("l", "r").distinct()


def _tiny_pairs(values: DataFrame, k: int) -> DataFrame:
    """Pairs whose shorter string has at most k characters, for a large k.

    Two such strings are always within distance k, so all of their pairs are the
    result; they are spread over blocks. A string of more than k characters must
    share a character with them.
    """
    tiny, others = values.where(F.length("v") <= k), values.where(F.length("v").between(k + 1, 2 * k))
    blocks = shuffle_partitions(values.sparkSession)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("h")
    dealt = tiny.select(_string(), F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("h"))
    left, right = _sides(dealt, tiny.select(_string(), every))
    both = left.join(right, (F.col("lh") == F.col("rh")) & _shorter("l", "r")).select("l", "r")
    letters = F.explode(F.array_distinct(F.split("v", ""))).alias("h")
    left, right = _sides(tiny.select(_string(), letters), others.select(_string(), letters))
    mixed = left.join(right, (F.col("lh") == F.col("rh")) & _close("l", "r", k)).select("l", "r").distinct()
    return both.unionByName(mixed)


def _pieces(length: Column, k: int, fine: bool = False) -> Column:
    """Number of pieces a string of this length is cut into, at least k+1, or k+3 finer ones."""
    if fine:
        return F.greatest(F.lit(k + TOGETHER), F.floor(length / F.lit(FINE_PIECE)).cast("int"))
    wanted = F.floor(length / F.lit(MIN_PIECE)).cast("int")
    return F.greatest(F.lit(k + 1), F.least(F.lit(SPARE_PIECES * (k + 1)), wanted))


def _piece_start(length: Column, pieces: Column, i: Column) -> Column:
    """0-based start of the i-th piece; also the end of the one before."""
    return F.floor(length.cast("bigint") * i / pieces).cast("int")


def _piece_hash(length: Column, i: Column, text: Column) -> Column:
    return F.xxhash64(length, i, text)


def _kept_pieces(texts: DataFrame, k: int, fine: bool = False) -> DataFrame:
    """(id, len, cost, keys): the k+1 (fine: k+3) least shared pieces, cost being how many strings share them."""

    start, end = (_piece_start(F.col("len"), F.col("pieces"), j) for j in (F.col("i"), F.col("i") + 1))
    own = (
        texts.select("id", "v", "len", _pieces(F.col("len"), k, fine).alias("pieces"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"))
        .select("id", "len", "i", _piece_hash(F.col("len"), F.col("i"), F.substr("v", start + 1, end - start)).alias("h"))
    )
    return _rarest(own, k + (TOGETHER if fine else 1))


def _rarest(own: DataFrame, wanted: int) -> DataFrame:
    """(id, len, cost, keys) from (id, len, i, h): the least shared keys of each string, in order of pieces."""
    shared = own.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("n", "h", "i"))), 1, wanted)
    in_order = F.array_sort(F.transform("kept", lambda p: F.struct(p["i"].alias("i"), p["h"].alias("h"))))
    return (
        own.join(_shuffled(shared), "h")
        .groupBy("id", "len")
        .agg(rarest.alias("kept"))
        .select(
            "id",
            "len",
            F.aggregate("kept", F.lit(0).cast("bigint"), lambda total, p: total + p["n"]).alias("cost"),
            F.transform(in_order, lambda p: p["h"]).alias("keys"),
        )
    )


def _look_ups(texts: DataFrame, k: int, direct: int, fine: bool = False) -> DataFrame:
    """(j, j_len, length, piece, shift, h2): keys under which pieces of shorter or equally long strings may occur in string j."""
    gap, length = F.col("gap"), F.col("len") - F.col("gap")
    start, end = (_piece_start(F.col("length"), F.col("pieces"), j) for j in (F.col("i"), F.col("i") + 1))
    # shifts s with |s| + |gap - s| <= k
    first, last = -F.floor((F.lit(k) - gap) / 2).cast("int"), F.floor((F.lit(k) + gap) / 2).cast("int")
    origin = F.greatest(F.col("start") + first, F.lit(0))
    at = F.col("start") + F.col("shift")
    size = F.col("end") - F.col("start")
    gaps = F.sequence(F.lit(0), F.least(F.lit(k), F.col("len") - direct - 1))
    return (
        texts.select("id", "v", "len", F.explode(gaps).alias("gap"))
        .select("id", "v", "len", "gap", length.alias("length"), _pieces(length, k, fine).alias("pieces"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"))
        .select("id", "v", "len", "gap", "length", "i", start.alias("start"), end.alias("end"))
        # the text a piece may lie in is taken from the string once for all shifts
        .select(
            "id", "len", "gap", "length", "i", "start", "end", origin.alias("origin"),
            F.substr("v", origin + 1, F.col("end") + last - origin).alias("text"),
        )
        .select("*", F.explode(F.sequence(first, last)).alias("shift"))
        .where((at >= 0) & (at + size <= F.col("len")))
        .select(
            F.col("id").alias("j"),
            F.col("len").alias("j_len"),
            "length",
            F.col("i").alias("piece"),
            "shift",
            _piece_hash(F.col("length"), F.col("i"), F.substr("text", at - F.col("origin") + 1, size)).alias("h2"),
        )
    )


def _among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key may be one of the keys (h): all of those that are, and about one in ``KEY_BITS`` of the others.

    Every task gets a bitmap of the keys' hashes, whose size is bounded; so look-ups that meet nothing are not shuffled.
    """
    count = keys.count()
    if count <= FEW_KEYS:
        return rows.join(F.broadcast(keys.select(F.col("h").alias("known"))), key == F.col("known"), "left_semi")
    bits = min(BITMAP_BITS, max(64 * BLOCK_WORDS, 1 << (KEY_BITS * count).bit_length()))
    at = keys.select(F.pmod("h", F.lit(bits)).alias("at"))
    set_bits = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    empty = rows.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = set_bits.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
    blocks = words.groupBy(F.floor(F.col("word") / BLOCK_WORDS).alias("block")).agg(in_order.alias("words"))
    placed = rows.withColumn("at", F.pmod(key, F.lit(bits)))
    word = F.get("words", F.shiftright("at", 6).bitwiseAND(BLOCK_WORDS - 1).cast("int"))
    found = F.call_function("shiftright", word, F.col("at").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    same = (F.floor(F.col("at") / (64 * BLOCK_WORDS)) == F.col("block")) & found
    return placed.join(F.broadcast(blocks), same).select(*rows.columns)


def _meet(index: DataFrame, look_ups: DataFrame) -> DataFrame:
    """(i, j): strings whose key (h) is among the look-ups (h2) of a string that is not shorter."""
    look_ups = _among(look_ups, F.col("h2"), index)
    same = (F.col("h") == F.col("h2")) & (F.col("i_len") <= F.col("j_len")) & (F.col("i") != F.col("j"))
    return index.join(_shuffled(look_ups), same).select("i", "j").distinct()


def _piece_candidates(kept: DataFrame, texts: DataFrame, k: int, direct: int) -> DataFrame:
    """Candidates for the strings of ``kept``, all longer than ``direct``."""
    index = kept.select(F.col("id").alias("i"), F.col("len").alias("i_len"), F.explode("keys").alias("h"))
    return _meet(index, _look_ups(texts, k, direct).select("j", "j_len", "h2"))


def _long_text_keys(texts: DataFrame, k: int, least: int, fine: bool = False) -> DataFrame:
    """(id, len, own, asked, letters): keys of texts of at least ``least`` characters, those they look up, and counts of letters."""
    most = None if fine else SPARE_PIECES * (k + 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [(*windows.text_keys(v, k, least, most), windows.letter_counts(v)) for v in texts]
            columns = []
            for lists in zip(*found):
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).view(np.int64))))
            if columns:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["id", "len", "own", "asked", "letters"])

    lists = ", ".join(f"{name} array<bigint>" for name in ("own", "asked", "letters"))
    return texts.select("id", "len", "v").mapInArrow(keys, f"id {texts.schema['id'].dataType.simpleString()}, len int, {lists}")


def _long_text_candidates(texts: DataFrame, k: int, least: int) -> DataFrame:
    """(i, j): candidates among texts of at least ``least`` characters, by keys that neither length nor shift changes."""
    keys = stored(_long_text_keys(texts, k, least))
    kept = stored(_rarest(_own_keys(keys), k + 1))
    crowded = F.col("cost") > CROWDED * (k + 1)
    found = _meet(_key_index(kept.where(~crowded)), _asked_keys(keys))
    many = kept.where(crowded)
    if not many.isEmpty():
        # what lies near a crowded text has one of its keys
        near = _asked_by(keys, _key_index(many)).select(F.col("j").alias("id")).distinct()
        near = _of_ids(texts, stored(near))
        near = stored(near.repartition(shuffle_partitions(texts.sparkSession), F.xxhash64("id")))
        many = stored(near.join(_shuffled(many.select("id")), "id", "left_semi"))
        grouped = stored(_templates(many, k))
        alike = stored(_template_candidates(grouped, k))
        fine = stored(_fine_key_candidates(many, near, grouped, k, least))
        found = found.unionByName(alike).unionByName(fine).distinct()
        remove_stored(near, many, grouped)
    found = stored(found)
    keys = _of_ids(keys, found.select(F.explode(F.array("i", "j")).alias("id")).distinct())
    # each edit takes away one key at most, and one letter and adds one
    left = keys.select(F.col("id").alias("i"), F.array_distinct("own").alias("own"), F.col("letters").alias("i_letters"))
    right = keys.select(F.col("id").alias("j"), "asked", F.col("letters").alias("j_letters"))
    enough = F.size(F.array_intersect("own", "asked")) >= F.size("own") - k

    def more(a: str, b: str) -> Column:
        over = F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0)))
        return F.aggregate(over, F.lit(0).cast("bigint"), lambda total, x: total + x)

    few_letters = (more("i_letters", "j_letters") <= k) & (more("j_letters", "i_letters") <= k)
    return found.join(_shuffled(left), "i").join(_shuffled(right), "j").where(enough & few_letters).select("i", "j")


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these distinct ids; others are not shuffled."""
    return _among(rows, F.xxhash64("id"), ids.select(F.xxhash64("id").alias("h"))).join(_shuffled(ids), "id", "left_semi")


def _key_index(kept: DataFrame, *more: str) -> DataFrame:
    return kept.select(F.col("id").alias("i"), F.col("len").alias("i_len"), *more, F.explode("keys").alias("h"))


def _own_keys(keys: DataFrame) -> DataFrame:
    return keys.select("id", "len", F.posexplode("own").alias("i", "h"))


def _asked_keys(keys: DataFrame, *more: str) -> DataFrame:
    return keys.select(F.col("id").alias("j"), F.col("len").alias("j_len"), *more, F.explode("asked").alias("h2"))


def _asked_by(keys: DataFrame, index: DataFrame) -> DataFrame:
    """The look-ups whose key is in the index."""
    asked = _among(_asked_keys(keys), F.col("h2"), index)
    return asked.join(_shuffled(index.select(F.col("h").alias("h2")).distinct()), "h2", "left_semi")


def _fine_key_candidates(crowded: DataFrame, texts: DataFrame, grouped: DataFrame, k: int, least: int) -> DataFrame:
    """Candidates for crowded long texts, by finer pieces, so that their own part falls into pieces of its own."""
    keys = stored(_long_text_keys(texts, k, least, fine=True))
    own = _own_keys(keys.join(_shuffled(crowded.select("id")), "id", "left_semi"))
    kept = stored(_rarest(own, k + 1))
    if grouped.isEmpty():
        return _meet(_key_index(kept), _asked_keys(keys))
    index = _key_index(_with_group(kept, "id", "i_group", grouped), "i_group")
    return _meet_across(index, _asked_keys(_with_group(keys, "id", "j_group", grouped), "j_group"), keys.count())


def _three_together(pieces: Column, gap: Column | None = None, k: int = 0) -> Column:
    """Keys of three (piece, shift, h) entries each, in order of pieces.

    With a gap, only of shifts that k edits can make: each change of the shift takes as
    many edits, and behind the last piece it has to be the gap.
    """

    def later(p: Column, spent: Column | None, last: bool) -> Column:
        def possible(q: Column) -> Column:
            after = q["piece"] > p["piece"]
            if spent is None:
                return after
            turn = spent + F.abs(q["shift"] - p["shift"]) + (F.abs(gap - q["shift"]) if last else F.lit(0))
            return after & (turn <= k)

        return F.filter(pieces, possible)

    def from_first(p: Column) -> Column:
        spent = None if gap is None else F.abs(p["shift"])

        def from_second(q: Column) -> Column:
            more = None if gap is None else spent + F.abs(q["shift"] - p["shift"])
            return F.transform(later(q, more, True), lambda r: F.xxhash64(p["h"], q["h"], r["h"]))

        return F.flatten(F.transform(later(p, spent, False), from_second))

    return F.array_distinct(F.flatten(F.transform(pieces, from_first)))


def _three_piece_candidates(crowded: DataFrame, texts: DataFrame, grouped: DataFrame, k: int, direct: int) -> DataFrame:
    """Candidates for crowded strings, by three of their k+3 rarest fine pieces at a time.

    Look-ups are put together only where each piece is some crowded string's kept one.
    Two strings of the same template group do not meet.
    """
    kept = stored(_kept_pieces(crowded, k, fine=True))
    listed = F.transform("keys", lambda h, at: F.struct(at.alias("piece"), F.lit(0).alias("shift"), h.alias("h")))
    together = _three_together(F.col("pieces"))

    def index_of(kept: DataFrame, *more: str) -> DataFrame:
        pieces = kept.select("id", "len", *more, listed.alias("pieces"))
        return pieces.select(F.col("id").alias("i"), F.col("len").alias("i_len"), *more, F.explode(together).alias("h"))

    # dealt by id once, so that what a string looks up is put together where it was made
    dealt = texts.select("id", "v", "len").repartition(shuffle_partitions(texts.sparkSession), "id")
    singles = stored(kept.select(F.explode("keys").alias("h")).distinct())
    hits = _among(_look_ups(dealt, k, direct, fine=True), F.col("h2"), singles)
    entry = F.struct("piece", "shift", F.col("h2").alias("h"))
    found = hits.groupBy("j", "j_len", "length").agg(F.collect_set(entry).alias("pieces"))
    keys = _three_together(F.col("pieces"), F.col("j_len") - F.col("length"), k)
    if grouped.isEmpty():
        return _meet(index_of(kept), found.select("j", "j_len", F.explode(keys).alias("h2")))
    named = _with_group(found, "j", "j_group", grouped).select("j", "j_len", "j_group", F.explode(keys).alias("h2"))
    return _meet_across(index_of(_with_group(kept, "id", "i_group", grouped), "i_group"), named, texts.count())


def _with_group(rows: DataFrame, own: str, group: str, grouped: DataFrame) -> DataFrame:
    """The rows with the group of their string; a string without a group is one of its own."""
    known = grouped.select(F.col("id").alias(own), F.col("g").alias("known"))
    named = F.coalesce("known", F.xxhash64(own)).alias(group)
    return rows.join(_shuffled(known), own, "left").select(*rows.columns, named)


def _meet_across(index: DataFrame, look_ups: DataFrame, strings: int) -> DataFrame:
    """``_meet`` for strings of different groups: groups meet under a key first, then their strings.

    Keys are dealt over passes, so that what is shuffled at once grows with the ``strings`` alone. A
    pair can come from several passes.
    """
    index = stored(index)
    look_ups = stored(_among(look_ups, F.col("h2"), index))
    passes = max(1, -(-look_ups.count() // max(PASS_ROWS, PASS_LOOK_UPS * strings)))
    found = [stored(_met_across(index, look_ups, passes, part)) for part in range(passes)]
    remove_stored(index, look_ups)
    return functools.reduce(DataFrame.unionByName, found)


def _met_across(index: DataFrame, look_ups: DataFrame, passes: int, part: int) -> DataFrame:
    index, look_ups = index.where(F.pmod("h", F.lit(passes)) == part), look_ups.where(F.pmod("h2", F.lit(passes)) == part)
    left, right = index.select("h", "i_group").distinct(), look_ups.select("h2", "j_group").distinct()
    met = left.join(_shuffled(right), (F.col("h") == F.col("h2")) & (F.col("i_group") != F.col("j_group"))).select("h", "i_group", "j_group")
    of_left = index.join(_shuffled(met), ["h", "i_group"])
    same = (F.col("l.h") == F.col("r.h2")) & (F.col("l.j_group") == F.col("r.j_group")) & (F.col("l.i_len") <= F.col("r.j_len"))
    return of_left.alias("l").join(_shuffled(look_ups.alias("r")), same).select("l.i", "r.j").distinct()


def _mixed_variant_count(length: int, k: int) -> int:
    return sum(comb(length, i) * comb(length - i, d) for i in range(k + 1) for d in range(k + 1 - i) if i <= length)


def _common_start(a: Column, b: Column) -> Column:
    """How many characters two strings begin with in common."""
    size = F.least(F.length(a), F.length(b))
    equal = F.zip_with(F.split(F.substr(a, F.lit(1), size), ""), F.split(F.substr(b, F.lit(1), size), ""), lambda x, y: x == y)
    at = F.array_position(equal, False)
    return F.when(at == 0, size).otherwise(at - 1).cast("int")


def _templates(crowded: DataFrame, k: int) -> DataFrame:
    """(id, g, len, rest): strings of a template group and what the group's common start and end leave of each."""
    by_digits = F.xxhash64(F.regexp_replace("v", "[0-9]+", "0"))
    by_ends = F.xxhash64(F.lit("ends"), F.substr("v", F.lit(1), F.lit(TEMPLATE_ENDS)), F.substr("v", F.lit(-TEMPLATE_ENDS), F.lit(TEMPLATE_ENDS)))
    marked = crowded.select("id", "v", "len", by_digits.alias("digits"), by_ends.alias("ends"))
    many = marked.groupBy("digits").agg(F.count(F.lit(1)).alias("alike"))
    g = F.when(F.col("alike") >= TEMPLATE_STRINGS, F.col("digits")).otherwise(F.col("ends")).alias("g")
    marked = stored(marked.join(_shuffled(many), "digits").select("id", "v", "len", g))
    groups = marked.groupBy("g").agg(
        F.count(F.lit(1)).alias("strings"),
        F.min("v").alias("first"), F.max("v").alias("last"),
        F.min(F.reverse("v")).alias("first_end"), F.max(F.reverse("v")).alias("last_end"),
        F.min("len").alias("shortest"), F.max("len").alias("longest"),
    )
    start = _common_start(F.col("first"), F.col("last"))
    groups = groups.where(F.col("strings") >= TEMPLATE_STRINGS).select("*", start.alias("start"))
    end = F.least(_common_start(F.col("first_end"), F.col("last_end")), F.col("shortest") - F.col("start"))
    groups = groups.select("g", "start", end.alias("end"), "longest")
    most = max(length for length in range(64) if _mixed_variant_count(length, k) <= TEMPLATE_VARIANTS)
    groups = groups.where(F.col("longest") - F.col("start") - F.col("end") <= most)
    rest = F.substr("v", F.col("start") + 1, F.col("len") - F.col("start") - F.col("end"))
    return marked.join(_shuffled(groups), "g").select("id", "g", "len", rest.alias("rest"))


def _mixed_variants(rest: Column, k: int) -> Column:
    """Distinct (text, open, deleted) with up to k places left open or characters deleted, from the end to the start."""

    def state(text: Column, place: Column, opened: Column, deleted: Column) -> Column:
        return F.struct(text.alias("text"), place.cast("int").alias("place"), opened.alias("open"), deleted.alias("deleted"))

    def edited(s: Column) -> Column:
        places = F.when(s["place"] > 1, F.sequence(F.lit(1), s["place"] - 1)).otherwise(F.array().cast("array<int>"))

        def both(p: Column) -> Column:
            before, after = F.substr(s["text"], F.lit(1), p - 1), F.substr(s["text"], p + 1)
            return F.array(
                state(F.concat(before, F.lit(OPEN_PLACE), after), p, s["open"] + 1, s["deleted"]),
                state(F.concat(before, after), p, s["open"], s["deleted"] + 1),
            )

        return F.flatten(F.transform(places, both))

    level = F.array(state(rest, F.length(rest) + 1, F.lit(0), F.lit(0)))
    found = level
    for _ in range(k):
        level = F.flatten(F.transform(level, edited))
        found = F.concat(found, level)
    return F.array_distinct(F.transform(found, lambda s: F.struct(s["text"], s["open"], s["deleted"])))


def _template_candidates(grouped: DataFrame, k: int) -> DataFrame:
    """(i, j): strings of one group whose rests are within the distance, the shorter or smaller first."""
    # few strings have many variants, so they are spread out
    spread = grouped.select("id", "g", "rest").repartition(shuffle_partitions(grouped.sparkSession), F.xxhash64("id"))
    listed = spread.select("id", "g", "rest", F.explode(_mixed_variants(F.col("rest"), k)).alias("x"))
    keyed = listed.select(
        "id", "rest", F.col("x.open").alias("open"), F.col("x.deleted").alias("deleted"),
        F.xxhash64("g", "x.open", "x.text").alias("h"),
    )
    left, right = keyed.alias("l"), keyed.alias("r")
    within = (F.col("l.h") == F.col("r.h")) & (F.col("l.open") + F.col("l.deleted") + F.col("r.deleted") <= k)
    # rests of a group differ in length as their strings do
    left_length, right_length = F.length("l.rest"), F.length("r.rest")
    shorter = (left_length < right_length) | ((left_length == right_length) & (F.col("l.rest") < F.col("r.rest")))
    return left.join(_shuffled(right), within & shorter).select(F.col("l.id").alias("i"), F.col("r.id").alias("j")).distinct()


def _joined_pairs(candidates: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The candidates that are within the distance, as strings."""
    candidates = stored(candidates)
    ids = stored(candidates.select(F.explode(F.array("i", "j")).alias("id")).distinct())
    if 2 * ids.count() < texts.count():
        texts = stored(_of_ids(texts, ids))
    left = texts.select(_string().alias("l"), F.col("id").alias("i"))
    right = texts.select(_string().alias("r"), F.col("id").alias("j"))
    return (
        candidates.join(_shuffled(left), "i")
        .join(_shuffled(right), "j")
        .where(_close("l", "r", k))
        .select("l", "r")
    )


def _pairs(df: DataFrame, column: str, k: int, order_col: str | None) -> DataFrame:
    """(a, b, distance) with a and b structs (v, n, f), the one of first position first."""
    values = distinct_values(df, column, order_col)
    if not is_string(df, column) or k < 1:
        found = values.limit(0).select(_string().alias("l"), _string().alias("r"))
    else:
        values = _spread(values)
        found = _found_pairs(values, k)
    swap = (F.col("r.f") < F.col("l.f")) | ((F.col("r.f") == F.col("l.f")) & (F.col("r.v") < F.col("l.v")))
    return found.select(
        F.when(swap, F.col("r")).otherwise(F.col("l")).alias("a"),
        F.when(swap, F.col("l")).otherwise(F.col("r")).alias("b"),
    ).withColumn("distance", F.levenshtein("a.v", "b.v", max(k, 0)))


def _spread(values: DataFrame) -> DataFrame:
    """The strings stored with an id, for several branches to read.

    Few short strings can mean much work, so they are spread out (by a hash of their own: a
    partitioning like that of the grouping would be merged into it). Large texts are left as
    the grouping dealt them, which saves a second shuffle of them.
    """
    values = stored(values.withColumn("id", F.monotonically_increasing_id()))
    partitions = shuffle_partitions(values.sparkSession)
    characters = values.agg(F.sum(F.length("v"))).first()[0] or 0
    if characters >= SPREAD_CHARACTERS * partitions:
        return values
    spread = stored(values.repartition(partitions, F.xxhash64("v")))
    remove_stored(values)
    return spread


def _look_up_count(k: int) -> int:
    """Look-ups a string may have for coarse pieces."""
    return SPARE_PIECES * (k + 1) ** 3


def _long_candidates(kept: DataFrame, texts: DataFrame, k: int, direct: int) -> DataFrame:
    """Candidates by single pieces, or by templates and three pieces together where single ones are too common."""
    enough = F.col("len") >= FINE_PIECE * (k + TOGETHER)
    crowded = (F.col("cost") > CROWDED * (k + 1)) & enough
    few = stored(_piece_candidates(kept.where(~crowded), texts, k, direct))
    many = kept.where(crowded).select("id")
    if many.isEmpty():
        return few
    many = stored(texts.join(many, "id", "left_semi"))
    grouped = stored(_templates(many, k))
    alike = stored(_template_candidates(grouped, k))
    return few.unionByName(alike).unionByName(_three_piece_candidates(many, texts, grouped, k, direct)).distinct()


def _found_pairs(values: DataFrame, k: int) -> DataFrame:
    limit = _variant_limit(k)
    texts = values.select("v", "n", "f", "id", F.length("v").alias("len"))
    # texts that are long for the distance have keys of their own; a pair is found as its shorter string is
    least = windows.shortest(k, limit)
    longest = texts.where(F.col("len") >= least)
    if longest.isEmpty():
        return _pairs_of_shorter(values, texts, k, limit)
    apart = _joined_pairs(_long_text_candidates(longest, k, least), longest, k)
    below = F.col("len") < least + k
    shorter = _pairs_of_shorter(values.where(F.length("v") < least + k), texts.where(below), k, limit)
    return apart.unionByName(shorter.where((F.length("l.v") < least) | (F.length("r.v") < least)))


def _pairs_of_shorter(values: DataFrame, texts: DataFrame, k: int, limit: int) -> DataFrame:
    if limit < k:
        long_texts = texts.where(F.col("len") > k)
        kept = stored(_kept_pieces(long_texts, k))
        return _tiny_pairs(values, k).unionByName(_joined_pairs(_long_candidates(kept, long_texts, k, k), long_texts, k))
    # strings by length, all that variants cannot serve as one: at most ``limit`` + k + 2 rows
    counted = texts.groupBy(F.least("len", F.lit(limit + k + 1)).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    by_length = {row["len"]: row["n"] for row in counted.collect()}
    rows = sum(n * _variant_count(length, k) for length, n in by_length.items() if length <= limit + k)
    direct = limit if rows <= FEW_VARIANTS else _direct_limit(k)

    shorter = texts.where(F.col("len") <= direct)
    lengths = {length for length in by_length if length <= direct}
    found = None
    if any(length > direct for length in by_length):
        long_texts = texts.where(F.col("len") > direct)
        variants = F.lit([_variant_count(length, k) for length in range(limit + 1)])
        count = F.get(variants, F.col("len"))
        # a string of moderately many variants is better served by them than by three pieces together
        served = (count <= _look_up_count(k)) | (F.col("len") < FINE_PIECE * (k + TOGETHER))
        dear = (F.col("len") <= limit) & (F.col("cost") > count) & served
        kept = stored(_kept_pieces(long_texts, k).withColumn("by_variants", F.coalesce(dear, F.lit(False))))
        found = _joined_pairs(_long_candidates(kept.where("not by_variants"), long_texts, k, direct), long_texts, k)
        varied = kept.where("by_variants").select("id", "len")
        lengths |= {row["len"] for row in varied.select("len").distinct().collect()}
        shorter = shorter.unionByName(long_texts.join(varied.select("id"), "id", "left_semi").select(*texts.columns))
    if lengths:
        by_variants = _variant_pairs(shorter, values, sorted(lengths), k)
        found = by_variants if found is None else found.unionByName(by_variants)
    return found if found is not None else values.limit(0).select(_string().alias("l"), _string().alias("r"))


def similar_pairs(
    df: DataFrame, column: str, threshold: int, order_col: str | None = None
) -> DataFrame:
    """(a, b, distance): distinct strings within the edit distance, earlier string first."""
    return _pairs(df, column, threshold, order_col).select(
        F.col("a.v").alias("a"), F.col("b.v").alias("b"), "distance"
    )


def find_duplicates(
    df: DataFrame, column: str, threshold: int, order_col: str | None = None
) -> DataFrame:
    """(value, candidate, rank): ranked replacements for each string with near copies.

    A string's own candidates include itself. Rank falls with occurrences times
    number of candidates, then with the smaller distance sum, then by text. The
    distance of a pair counts, on both sides, once per occurrence of its later string.
    """
    pairs = cut_lineage(_pairs(df, column, threshold, order_col))
    weighted = F.col("distance") * F.col("b.n")
    both = pairs.select("a", "b", weighted.alias("d")).unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), weighted.alias("d"))
    )
    strings = both.groupBy(F.col("a.v").alias("candidate"), F.col("a.n").alias("n")).agg(
        (F.count(F.lit(1)) + 1).alias("size"), F.sum("d").alias("dist_sum")
    )
    strings = strings.select("candidate", (F.col("n") * F.col("size")).alias("weight"), "dist_sum")
    links = both.select(F.col("a.v").alias("value"), F.col("b.v").alias("candidate"))
    ranked = links.join(_shuffled(strings), "candidate").unionByName(
        strings.select(F.col("candidate").alias("value"), "candidate", "weight", "dist_sum")
    )
    best_first = Window.partitionBy("value").orderBy(F.desc("weight"), "dist_sum", F.desc("candidate"))
    return ranked.select("value", "candidate", F.row_number().over(best_first).alias("rank"))


def candidate_lists(duplicates: DataFrame) -> DataFrame:
    """(value, candidates): the ranked candidates of each string as one array.

    A string's array must fit a row; ``find_duplicates`` gives the same as rows.
    """
    entries = F.array_sort(F.collect_list(F.struct("rank", "candidate")))
    return duplicates.groupBy("value").agg(F.transform(entries, lambda e: e["candidate"]).alias("candidates"))


def resolve_chain(mapping: dict[str, str]) -> dict[str, str]:
    """Follow replacements to their end; ones leading back to themselves are dropped."""
    resolved = {}
    for start in mapping:
        seen, current = {start}, mapping[start]
        while current in mapping and current != start:
            if current in seen:
                raise ValueError(f"replacement of {start!r} runs into the cycle at {current!r}")
            seen.add(current)
            current = mapping[current]
        if current != start:
            resolved[start] = current
    return resolved


def resolve_chain_table(mapping: DataFrame) -> DataFrame:
    """``resolve_chain`` for a (old, new) table of any size, by doubling the steps taken."""
    mapping = cut_lineage(mapping.select("old", "new"))
    total = mapping.count()
    if total == 0:
        return mapping
    steps, jumped = 1, mapping
    while steps <= total:
        ahead = mapping if steps == 1 else jumped
        ahead = ahead.select(F.col("old").alias("_at"), F.col("new").alias("_next"))
        jumped = cut_lineage(
            jumped.join(ahead, F.col("new") == F.col("_at"), "left").select(
                "old", F.coalesce("_next", "new").alias("new")
            )
        )
        steps *= 2
        unfinished = jumped.join(mapping.select(F.col("old").alias("_key")), F.col("new") == F.col("_key"), "left_semi")
        if unfinished.isEmpty():
            return jumped
    # whatever still points at a key sits on a cycle or runs into one
    on_cycle = unfinished.select(F.col("new").alias("_cycle")).distinct()
    into = unfinished.join(on_cycle, F.col("old") == F.col("_cycle"), "left_anti").limit(1).collect()
    if into:
        raise ValueError(f"replacement of {into[0]['old']!r} runs into a cycle")
    return cut_lineage(jumped.join(on_cycle, F.col("old") == F.col("_cycle"), "left_anti"))


def replace_duplicates(
    df: DataFrame, column: str, mapping: dict[str, str] | DataFrame, chain: bool = False
) -> DataFrame:
    """Replace strings by a map, given as dict or as (old, new) table with unique ``old``.

    With ``chain`` replacements are followed to their end (a to b, b to c gives a to c).
    A map of known small size goes to every task whole, a larger one is shuffled.
    """
    if not is_string(df, column):
        return df
    if isinstance(mapping, dict):
        pairs = resolve_chain(mapping) if chain else mapping
        if not pairs:
            return df
        table = df.sparkSession.createDataFrame(list(pairs.items()), "old string, new string")
        if sum(len(old.encode()) + len(new.encode()) + 64 for old, new in pairs.items()) <= MAP_BYTES:
            table = F.broadcast(table)
    else:
        repeated = F.raise_error(F.concat(F.lit("several replacements for "), F.col("old")))
        table = (
            mapping.groupBy("old")
            .agg(F.count(F.lit(1)).alias("n"), F.min("new").alias("new"))
            .select("old", F.when(F.col("n") > 1, repeated.cast("string")).otherwise(F.col("new")).alias("new"))
        )
        # written first, so that Spark plans the join knowing the size of the map
        table = resolve_chain_table(table) if chain else cut_lineage(table)
    table = table.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    joined = df.join(table, col(column) == F.col("_old"), "left")
    return replace_columns(joined, {column: F.coalesce(F.col("_new"), col(column))}).drop("_old", "_new")
