"""Quality rules whose limits come from the corpus, in DataFrame functions only.

Each document gets a few counts. For every language and source the distribution of each
measure is kept as a quantile sketch: counts in buckets whose width is within 1/64 of their
value. Sketches of parts merge by adding counts, so one pass with partial aggregation makes
all of them, and adding up the sources gives a language's sketch, adding up the languages
that of the corpus. Limits come from the tails of a group's own sketch: its 90th
percentile plus ``reach`` times the distance from the median to it (below, the 10th percentile
less ``reach`` times the distance down to it), so a group's usual documents stay, and
whatever lies far outside its own group goes. A distance counts as one bucket at least (one thousandth
for small values), as the sketch tells no smaller one; that decides only where it is zero. A few symbols, repeated lines or repeated words (``few``) tell
nothing about a document, as a short one exceeds any rate with them. Groups of fewer than
``least`` documents take the limits of their language, or else of the corpus.

Fixed base rules reject first, and only documents that pass them make up the sketches.

Defined results: null texts count as empty and fail the base rules; null languages and
sources are groups of their own; repeated rows count as often as they occur; an empty table
stays empty; input columns named like an added column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinseframe.llm.frames import Scratch, all_equal, without

WHITE = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: measures in thousandths, and the count each of them rates
MEASURES = {
    "m_length": "1000L * word_chars div greatest(n_words, 1)",
    "m_symbols": "1000L * n_symbols div greatest(n_words, 1)",
    "m_dup_lines": "1000L * n_dup_lines div greatest(n_lines, 1)",
    "m_repeats": "1000L * n_repeat_words div greatest(n_words, 1)",
}
COUNT_OF = {"m_symbols": "n_symbols", "m_dup_lines": "n_dup_lines", "m_repeats": "n_repeat_words"}
#: measures with a lower limit as well
TWO_SIDED = ("m_length",)


@dataclass(frozen=True)
class Rules:
    """``reach`` tail distances beyond the tails; groups of fewer than ``least`` documents have no limits of their own.

    Up to ``few_symbols`` symbols, ``few_lines`` repeated lines and ``few_repeats`` repeated words pass in any document.
    """

    least_words: int = 50
    most_repeats_percent: int = 50
    reach: int = 4
    least: int = 100
    few_symbols: int = 5
    few_lines: int = 3
    few_repeats: int = 30

    @property
    def few(self) -> dict[str, int]:
        return {"m_symbols": self.few_symbols, "m_dup_lines": self.few_lines, "m_repeats": self.few_repeats}


def counted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of each text; lines without a word do not count.

    A repeated word stands in a 3-word window that the text has twice.
    """
    df = without(df, *COUNTS)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    words = F.filter(F.split(text, WHITE), lambda word: word != "")
    columns = [F.col(f"`{c}`") for c in df.columns]
    split = df.select(*columns, words.alias("q_words"), lines.alias("q_lines"), text.alias("q_text"))
    each = F.transform("q_words", lambda word, i: F.xxhash64(word, F.get("q_words", i + 1), F.get("q_words", i + 2)))
    # hash and place of each window; a trailing pair of words has no window
    windows = F.slice(each, F.lit(1), F.greatest(F.size("q_words") - 2, F.lit(0)))
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = split.select(*columns, "q_words", "q_lines", "q_text", placed.alias("q_windows"))
    twice = F.filter(
        "q_windows",
        lambda w, i: (w["h"] == F.get("q_windows", i - 1)["h"]) | (w["h"] == F.get("q_windows", i + 1)["h"]),
    )
    places = F.sort_array(F.transform(twice, lambda w: w["i"]))
    found = found.select(*columns, "q_words", "q_lines", "q_text", places.alias("q_places"))
    # every repeated window adds the words up to the next one's first, three at most
    gaps = F.transform("q_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("q_places", i + 1) - p, F.lit(3))))
    white = F.translate("q_text", " \t\n\x0b\f\r", "")
    return found.select(
        *columns,
        F.size("q_words").cast("long").alias("n_words"),
        F.length(white).cast("long").alias("word_chars"),
        (F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap).cast("long").alias("n_repeat_words"),
        F.size("q_lines").cast("long").alias("n_lines"),
    )


def base_failed(rules: Rules) -> Column:
    few = F.col("n_words") < rules.least_words
    return few | (100 * F.col("n_repeat_words") > rules.most_repeats_percent * F.col("n_words"))


def bits_dropped(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - 7, F.lit(0))


def bucket(value: Column) -> Column:
    """The largest number not above the value that has seven significant binary digits."""
    excess = bits_dropped(value)
    return F.call_function("shiftleft", F.call_function("shiftright", value, excess), excess)


def bucket_width(value: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits_dropped(value))


def sketches(measured: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketches of all groups."""
    names = ", ".join(f"'{m}', {m}" for m in MEASURES)
    long = measured.select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), *[F.expr(e).alias(m) for m, e in MEASURES.items()]
    ).selectExpr("lang", "source", f"stack({len(MEASURES)}, {names}) AS (measure, value)")
    return long.groupBy("lang", "source", "measure", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str], rules: Rules) -> DataFrame:
    """Lower and upper limit of every measure, and the size, of each group."""
    group = Window.partitionBy(*by, "measure")
    running = sketch.select(
        *by,
        "measure",
        "bucket",
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )

    def at(tenths: int) -> Column:
        return F.min(F.when(10 * F.col("upto") >= tenths * F.col("total"), F.col("bucket")))

    tails = running.groupBy(*by, "measure").agg(
        F.max("total").alias("total"), at(1).alias("low"), at(5).alias("middle"), at(9).alias("high")
    )
    limits = []
    for m in MEASURES:
        here = F.col("measure") == m
        above = F.col("high") + rules.reach * F.greatest(F.col("high") - F.col("middle"), bucket_width(F.col("middle")))
        limits.append(F.max(F.when(here, above)).alias(f"{m}_most"))
        if m in TWO_SIDED:
            below = F.col("low") - rules.reach * F.greatest(F.col("middle") - F.col("low"), bucket_width(F.col("low")))
            limits.append(F.max(F.when(here, below)).alias(f"{m}_least"))
    return tails.groupBy(*by).agg(F.max("total").alias("documents"), *limits)


def limits_of(measured: DataFrame, lang_col: str, source_col: str, rules: Rules) -> DataFrame:
    """Limits of every (lang, source) that has a document, from its own sketch or a merged one."""
    scratch = Scratch(measured.sparkSession)
    own = scratch.stored(sketches(measured.where(~base_failed(rules)), lang_col, source_col), "sketches")
    wide = [f"{m}_most" for m in MEASURES] + [f"{m}_least" for m in TWO_SIDED]
    groups = fences(own, ["lang", "source"], rules)
    langs = fences(merged(own, ["lang"]), ["lang"], rules)
    # one row: the limits of the corpus
    whole = fences(merged(own.withColumn("every", F.lit(1)), ["every"]), ["every"], rules).first()
    g, la = groups.alias("g"), langs.alias("l")
    level = F.when(F.col("g.documents") >= rules.least, F.lit(0)).when(F.col("l.documents") >= rules.least, F.lit(1)).otherwise(2)
    both = g.join(la, F.col("g.lang").eqNullSafe(F.col("l.lang")))
    chosen = [
        F.when(level == 0, F.col(f"g.{c}")).when(level == 1, F.col(f"l.{c}")).otherwise(F.lit(whole and whole[c]).cast("long")).alias(c)
        for c in wide
    ]
    return both.select(F.col("g.lang").alias("limit_lang"), F.col("g.source").alias("limit_source"), *chosen)


def judged(df: DataFrame, lang_col: str = "lang", source_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to counted rows.

    The limits are stored, so their exact size is known when Spark chooses the join.
    """
    df = without(df, "base_failed", "kept")
    limits = Scratch(df.sparkSession).stored(limits_of(df, lang_col, source_col, rules), "limits")
    inside = F.lit(True)
    for m, expression in MEASURES.items():
        value = bucket(F.expr(expression))  # the limits are made of buckets, too
        usual = value <= F.col(f"{m}_most")
        inside = inside & (usual | (F.col(COUNT_OF[m]) <= rules.few[m]) if m in COUNT_OF else usual)
        if m in TWO_SIDED:
            inside = inside & (value >= F.col(f"{m}_least"))
    same = all_equal([F.col(f"`{lang_col}`"), F.col(f"`{source_col}`")], [F.col("limit_lang"), F.col("limit_source")])
    failed = base_failed(rules)
    return df.join(limits, same, "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(F.coalesce(inside, F.lit(False))).alias("kept"),
    )


def quality_filter(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows that pass, as they came. Counts are made once and stored with the rows."""
    measured = Scratch(df.sparkSession).stored(counted(df, text_col), "counted")
    return judged(measured, lang_col, source_col, rules).where("kept").select(*[F.col(f"`{c}`") for c in df.columns])
