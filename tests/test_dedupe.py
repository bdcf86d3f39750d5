"""Near-duplicate search against brute force, and replacement maps."""

import gc
import random
import time

import pytest
from pyspark.sql import functions as F

from rinseframe.functions import windows
from rinseframe.operators import dedupe


def distance(a: str, b: str, k: int) -> int:
    """Edit distance where it is at most k, else some number above k."""
    far = k + 1
    row = {j: j for j in range(min(len(b), k) + 1)}
    for i, x in enumerate(a, 1):
        following = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            if j == 0:
                following[j] = i
                continue
            change = row.get(j - 1, far) + (x != b[j - 1])
            following[j] = min(row.get(j, far) + 1, following.get(j - 1, far) + 1, change)
        row = following
    return row.get(len(b), far)


def brute_force(strings, k):
    ordered = sorted(set(strings))
    return {
        (a, b, d)
        for i, a in enumerate(ordered)
        for b in ordered[i + 1 :]
        if abs(len(a) - len(b)) <= k and (d := distance(a, b, k)) <= k
    }


def mutated(source, text, edits, alphabet):
    letters = list(text)
    for _ in range(edits):
        kind, at = source.random(), source.randrange(len(letters) + 1)
        if kind < 0.33:
            letters.insert(at, source.choice(alphabet))
        elif letters and kind < 0.66:
            letters.pop(min(at, len(letters) - 1))
        elif letters:
            letters[min(at, len(letters) - 1)] = source.choice(alphabet)
    return "".join(letters)


def strings_for(k, seed):
    """Short ones, ones around the length limits, long ones sharing a template."""
    source, alphabet = random.Random(seed), "abcdé"
    short = ["".join(source.choices(alphabet, k=source.randrange(2 * k + 3))) for _ in range(50)]
    limit = max(dedupe._variant_limit(k), k)
    long = []
    for _ in range(6):
        base = "template-prefix-" * 2 + "".join(source.choices(alphabet, k=max(1, limit - 34 + source.randrange(60))))
        long += [mutated(source, base, source.randrange(k + 2), alphabet) for _ in range(5)]
    edge = ["".join(source.choices("ab", k=limit + d)) for d in (-1, 0, 0, 1, 2) for _ in range(3)]
    return short + long + edge + [mutated(source, e, k, "ab") for e in edge]


def found_pairs(spark, strings, k):
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    rows = [tuple(r) for r in dedupe.similar_pairs(df, "s", k).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(
    "k, few_variants", [(1, 1_000_000), (2, 1_000_000), (3, 1_000_000), (1, 0), (2, 0), (3, 0), (5, 0), (8, 0)]
)
def test_pairs_equal_brute_force(spark, monkeypatch, k, few_variants):
    monkeypatch.setattr(dedupe, "FEW_VARIANTS", few_variants)
    strings = strings_for(k, seed=k)
    assert found_pairs(spark, strings, k) == brute_force(strings, k)


def test_numbered_template(spark, monkeypatch):
    """All strings share their pieces, so variants take over."""
    monkeypatch.setattr(dedupe, "FEW_VARIANTS", 0)
    strings = [f"https://www.example.com/products/{i:07d}" for i in range(0, 3000, 11)]
    assert found_pairs(spark, strings, 1) == brute_force(strings, 1)


def test_whole_documents(spark):
    texts = [
        row["text"]
        for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    ]
    source = random.Random(3)
    copies = [mutated(source, t, edits, "xyz ") for t in texts[:30] if len(t) < 3000 for edits in (1, 2, 3, 4)]
    k, strings = 3, [t for t in texts if len(t) < 3000][:60] + copies
    assert found_pairs(spark, strings, k) == brute_force(strings, k)


R1 = ["ABC", "ABD", "DBC", "DEC", "ADC", "DEF", "ABC", "XYZ", "DEF", "ABC", "XYH", "XYI"]


@pytest.mark.parametrize(
    "k, expected",
    [
        (
            1,
            {
                "ABC": "ABC DBC ADC ABD",
                "ABD": "ABC ABD",
                "DBC": "ABC DBC DEC",
                "ADC": "ABC ADC",
                "DEC": "DEF DBC DEC",
                "DEF": "DEF DEC",
                "XYZ": "XYZ XYI XYH",
                "XYH": "XYZ XYI XYH",
                "XYI": "XYZ XYI XYH",
            },
        ),
        (
            2,
            {
                "ABC": "ABC DBC DEC ADC ABD",
                "ABD": "ABC DBC ADC ABD",
                "DBC": "ABC DEF DBC DEC ADC ABD",
                "DEC": "ABC DEF DBC DEC ADC",
                "ADC": "ABC DBC DEC ADC ABD",
                "DEF": "DEF DBC DEC",
                "XYZ": "XYZ XYI XYH",
                "XYH": "XYZ XYI XYH",
                "XYI": "XYZ XYI XYH",
            },
        ),
    ],
)
def test_ranked_candidates(spark, k, expected):
    df = spark.createDataFrame(list(enumerate(R1)) + [(99, None)], "i int, s string")
    lists = dedupe.candidate_lists(dedupe.find_duplicates(df, "s", k, order_col="i")).collect()
    assert {r["value"]: " ".join(r["candidates"]) for r in lists} == expected


def by_definition(strings, k):
    """The ranking as a loop over rows."""
    first_seen = list(dict.fromkeys(strings))
    count = {s: strings.count(s) for s in first_seen}
    near, total = {}, {}
    for i, a in enumerate(first_seen):
        for b in first_seen[i + 1 :]:
            d = distance(a, b, k)
            if d <= k:
                for s, other in ((a, b), (b, a)):
                    near.setdefault(s, {s}).add(other)
                    total[s] = total.get(s, 0) + d * count[b]
    return {
        s: sorted(near[s], key=lambda c: (count[c] * len(near[c]), -total[c], c), reverse=True) for s in near
    }


@pytest.mark.parametrize("seed", range(2))
def test_ranking_equals_definition(spark, seed):
    source = random.Random(seed)
    strings = ["".join(source.choices("abAB", k=source.randrange(1, 6))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(strings)), "i int, s string")
    lists = dedupe.candidate_lists(dedupe.find_duplicates(df, "s", 2, order_col="i")).collect()
    assert {r["value"]: r["candidates"] for r in lists} == by_definition(strings, 2)


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert dedupe.find_duplicates(df, "s", 0).count() == 0
    assert dedupe.find_duplicates(df, "n", 1).count() == 0
    assert dedupe.similar_pairs(df.limit(0), "s", 2).count() == 0


def test_similarity_plan_has_only_equi_joins(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "FEW_VARIANTS", 0)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = dedupe.similar_pairs(df, "text", 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_exploded_keys_are_not_broadcast(spark):
    """Their size cannot be told from that of the files, so small files must not bring a broadcast about."""
    for text, k in (("Customer#%09d", 1), ("https://www.example.org/en/%06d?utm_source=feed", 2)):
        df = spark.createDataFrame([(text % i,) for i in range(3000)], "s string")
        plan = dedupe.similar_pairs(df, "s", k)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def long_texts(k, seed):
    """Texts around the least length of long ones and around a step, each with edited copies."""
    source, alphabet = random.Random(seed), "abcdefghij klmnopé"
    least = windows.shortest(k, dedupe._variant_limit(k))
    texts = []
    for length in (least - 2, least, least + 1, least + windows.STEP - 1, least + windows.STEP + 1, 3 * least):
        base = "".join(source.choices(alphabet, k=length))
        texts += [base, *(mutated(source, base, edits, alphabet) for edits in (1, k // 2 + 1, k, k, k + 1))]
        texts += [base[k:], "x" * k + base, "".join(source.choices("ab", k=3)) + base[:-3]]
    return texts + ["ab" * least, "ab" * least + "a", "b" + "ab" * least, "Ü" * least, "Ü" * (least + k)]


@pytest.mark.parametrize("k", [2, 8])
def test_long_texts_lose_no_pair(spark, k):
    texts = long_texts(k, k)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = [tuple(r) for r in dedupe.similar_pairs(df, "s", k).collect()]
    assert sorted(rows) == sorted(brute_force(texts, k))


def test_crowded_long_texts_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "CROWDED", 1)
    texts = long_texts(2, 5)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = [tuple(r) for r in dedupe.similar_pairs(df, "s", 2).collect()]
    assert sorted(rows) == sorted(brute_force(texts, 2))


def test_long_texts_look_up_few_keys(spark):
    """One or two for each piece, not one for each difference of lengths and shift."""
    source, k = random.Random(4), 8
    df = spark.createDataFrame([("".join(source.choices("abcdefgh ", k=2000)),) for _ in range(50)], "s string")
    values = dedupe.distinct_values(df, "s")
    texts = values.select("v", F.unhex(F.md5("v")).alias("id"), F.length("v").alias("len"))
    keys = dedupe._long_text_keys(texts, k, windows.shortest(k)).select(F.size("asked").alias("n"))
    assert keys.agg(F.max("n")).first()[0] <= 5 * dedupe.SPARE_PIECES * (k + 1)
    assert dedupe._look_ups(texts, k, k).count() > 50 * 1500


def test_bitmap_keeps_known_keys(spark, monkeypatch):
    """Look-ups that meet no key are dropped before they are shuffled, none that does."""
    monkeypatch.setattr(dedupe, "FEW_KEYS", 0)
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    rows = spark.range(100_000).select("id", F.xxhash64("id").alias("h2"))
    left = dedupe._among(rows, F.col("h2"), keys)
    assert left.where("id < 5000").count() == 5000
    assert left.count() < 5000 + 95_000 / 8


def test_pairs_through_bitmaps_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "FEW_KEYS", 0)
    monkeypatch.setattr(dedupe, "PASS_ROWS", 1)
    monkeypatch.setattr(dedupe, "PASS_LOOK_UPS", 20)
    monkeypatch.setattr(dedupe, "FEW_VARIANTS", 0)
    strings = [f"https://{host}.example.org/en/{i}{end}" for i in range(100, 400, 7) for host in ("m", "www", "wwv") for end in ("", "/")]
    assert found_pairs(spark, strings, 2) == brute_force(strings, 2)


def shuffled_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_steps_free_their_shuffles(spark):
    """Before the result is read, no step's keys are left on disk, which are many times the strings."""
    df = spark.createDataFrame([(f"https://www.example.org/{i % 40:02d}/{i * 7919 % 100000}/a",) for i in range(2000)], "s string")
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)
    before = shuffled_bytes(spark)
    pairs = dedupe.similar_pairs(df, "s", 2)
    time.sleep(2)
    assert shuffled_bytes(spark) - before < 300_000
    assert pairs.count() > 0


def test_texts_without_candidates_are_not_shuffled(spark):
    """Texts are read again for candidates alone: the last joins shuffle a table that holds few rows."""
    source = random.Random(9)
    texts = ["".join(source.choices("abcdefgh ", k=600)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0] + "x"]], "s string")
    pairs = dedupe.similar_pairs(df, "s", 8)
    rows = [spark.read.parquet(path) for path in {path.rsplit("/", 1)[0] for path in pairs.inputFiles()}]
    assert 2 in [table.where("length(v) > 500").count() for table in rows if "v" in table.columns]
    assert pairs.count() == 1


# ---- replacement maps

CHAIN = {"a": "b", "b": "c", "x": "x", "p": "q", "q": "p"}


def replaced(spark, mapping, chain):
    df = spark.createDataFrame([(s,) for s in ["a", "b", "x", "p", "q", "z", None]], "s string")
    result = dedupe.replace_duplicates(df, "s", mapping, chain)
    return sorted((r["s"] or "") for r in result.collect())


def as_table(spark, mapping):
    return spark.createDataFrame(list(mapping.items()), "old string, new string")


@pytest.mark.parametrize("table", [False, True])
def test_replace(spark, table):
    mapping = as_table(spark, CHAIN) if table else CHAIN
    assert replaced(spark, mapping, False) == ["", "b", "c", "p", "q", "x", "z"]
    assert replaced(spark, mapping, True) == ["", "c", "c", "p", "q", "x", "z"]


@pytest.mark.parametrize("table", [False, True])
def test_cycle_beside_the_start(spark, table):
    cyclic = {"d": "e", "e": "f", "f": "e"}
    with pytest.raises(ValueError, match="cycle"):
        replaced(spark, as_table(spark, cyclic) if table else cyclic, True)


@pytest.mark.parametrize("seed", range(2))
def test_chain_table_equals_dict(spark, seed):
    source = random.Random(seed)
    names = [f"n{i:03d}" for i in range(200)]
    # replacements only go forward: long chains and stars, no cycle
    mapping = {n: names[min(199, i + source.choice([1, 1, 2, 150]))] for i, n in enumerate(names[:-1])}
    resolved = {r["old"]: r["new"] for r in dedupe.resolve_chain_table(as_table(spark, mapping)).collect()}
    assert resolved == dedupe.resolve_chain(mapping)


def test_repeated_key_in_table(spark):
    twice = spark.createDataFrame([("a", "b"), ("a", "c")], "old string, new string")
    with pytest.raises(Exception, match="several replacements"):
        replaced(spark, twice, False)


def test_replace_numbers_is_unchanged(spark):
    df = spark.createDataFrame([(1,)], "n int")
    assert dedupe.replace_duplicates(df, "n", {"1": "2"}) is df


@pytest.mark.parametrize("k", [2, 3])
@pytest.mark.parametrize("length", [40, 120])
def test_candidates_of_templates_grow_with_the_table(spark, k, length):
    """A template with random numbers: a few candidates for each string, however many strings there are."""
    rng = random.Random(length + k)
    head = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz/", k=length // 2 - 6))
    tail = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz/", k=length - len(head) - 12))

    def candidates(n):
        texts = {head + "".join(rng.choices("0123456789", k=12)) + tail for _ in range(n)}
        frame = spark.createDataFrame([(t, len(t), i) for i, t in enumerate(texts)], "v string, len int, id int")
        frame = frame.selectExpr("v", "1L AS n", "v AS f", "unhex(md5(v)) AS id", "len")
        kept = dedupe._kept_pieces(frame, k)
        return dedupe._long_candidates(kept, frame, k, k).count()

    for n in (1000, 6000):  # of each piece kept, and of each shift it may have
        assert candidates(n) <= n * dedupe.CROWDED * (k + 1) ** 2


def test_templates_lose_no_pair(spark):
    rng = random.Random(8)
    texts = set()
    while len(texts) < 400:
        number = "".join(rng.choices("01", k=12))
        texts.add(f"https://www.example.org/shop/catalogue/item/{number}/details.html?language=en")
        if rng.random() < 0.2:
            texts.add(f"https://www.example.org/shop/cataloge/item/{number}/details.html?language=e")
    for k in (1, 2):
        frame = spark.createDataFrame([(t,) for t in texts], "s string")
        found = {(r["a"], r["b"]): r["distance"] for r in dedupe.similar_pairs(frame, "s", k).collect()}
        expected = {}
        ordered = sorted(texts)
        for i, a in enumerate(ordered):
            for b in ordered[i + 1 :]:
                d = distance(a, b, k)
                if d <= k:
                    expected[a, b] = d
        assert found == expected

