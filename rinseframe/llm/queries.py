"""One query per training-data operator over its whole table, with production parameters.

Each thin query applies its operator and derives the columns asked for from what the
operator returns; ``oracle.ORACLE`` holds SQL for those that SQL can express.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseframe.llm import alignment, extraction, near, packing, pieces, preferences, quality, sharding, substrings, token_files, url_filter, vectors, whitening
from rinseframe.llm.frames import Scratch
from rinseframe.plans.lineage import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARDS = 8
SEQUENCE_TOKENS = 1024
END_ID = 2
BYTE_BPE = {
    "tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"),
    "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    "pattern": public_tokenizers.PATTERN,
}
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
COMPONENTS = 16
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_jump_shards(spark, sf):
    """Every document into one of eight shards by its id."""
    documents = read(spark, sf, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    columns = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"]
    return sharding.sharded(documents, "doc_id", SHARDS).select(*columns)


def packed_pieces(documents: DataFrame, *digests) -> DataFrame:
    pieces = packing.token_pieces(documents, "text", end_id=END_ID, capacity=SEQUENCE_TOKENS, **BYTE_BPE)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", *digests), "length", SEQUENCE_TOKENS)


@query
def op2_best_fit_packing(spark, sf):
    """Every document's tokens into sequences of at most 1024."""
    documents = read(spark, sf, "documents").select("doc_id", "text")
    return packed_pieces(documents, F.crc32("ids").alias("ids_crc32"))


@query
def op3_substring_dedup(spark, sf):
    """Passages of 13 words that a document of smaller id has, taken out of whole documents."""
    documents = read(spark, sf, "documents").select("doc_id", "text")
    found = substrings.drop_repeats(documents, length=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_tensored_minhash(spark, sf):
    """Components of documents whose 3-word shingle sets are similar by 0.85 or more."""
    documents = read(spark, sf, "documents").select("doc_id", "text")
    found = near.near_duplicates(documents, k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_metric_range_join(spark, sf):
    """Components of vectors at a cosine of 0.95 or more, and each vector's links."""
    found = vectors.similar_groups(read(spark, sf, "embeddings").select("vec_id", "embedding"), cosine=0.95)
    return found.select("vec_id", "n_links", "component_id", "kept")


@query
def op4_preference_format(spark, sf):
    """Neighbouring conversations as chosen and rejected: shared prompt, completions, masks."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    found = preferences.preference_examples(turns, preferences.neighbours(turns))

    def spans(name: str):
        listed = F.transform(name, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(listed, ",").alias(name)

    return found.withColumns({name: spans(name) for name in ("chosen_mask", "rejected_mask")})


@query
def op5_line_block_extraction(spark, sf):
    """The main text of every page."""
    pages = read(spark, sf, "pages").select("page_id", "url", "html")
    return extraction.extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_piece_merge_rounds(spark, sf):
    """Ids of every text, and what they decode to."""
    documents = read(spark, sf, "documents").select("doc_id", "text")
    found = pieces.encoded(documents, "text", PIECE_MODEL, "ids", "decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_adaptive_quality(spark, sf):
    """Counts of every document, and whether it lies inside the limits of its language and source."""
    documents = read(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    counts = Scratch(spark).stored(quality.counted(documents).drop("text"), "counts")
    return quality.judged(counts).drop("lang", "source")


@query
def op8_bloom_url_rules(spark, sf):
    """Host, path, rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, verdict string")
    return url_filter.judge_urls(read(spark, sf, "pages").select("page_id", "url"), rules).drop("url")


@query
def op11_bit_packed_ids(spark, sf):
    """Every document's ids written as bits in ascending order of ids, and read back from the files."""
    documents = read(spark, sf, "documents").select("doc_id", "text")
    path = new_path(spark, "token-files")
    reader = token_files.text_reader(WORD_BPE, END_ID)
    token_files.write_tokens(documents, path, "doc_id", "text", token_files.vocabulary_of(WORD_BPE), reader)
    found = token_files.read_tokens(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_diagonal_alignment(spark, sf):
    """Groups and links of every document's tokens in two vocabularies, and how common the links are."""

    def groups_sha256(found: alignment.Found) -> list[str]:
        """Digest of the groups' decimal ids; empty without groups."""
        groups = [found[c] for c in ("a", "b", "a_sizes", "b_sizes")]
        spelled, sizes = alignment.spelled_groups(*groups, alignment.decimals_of(1 << 16))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(found["group_count"])])].tolist()
        data = spelled.tobytes()
        return [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:])]

    documents = read(spark, sf, "documents").select("doc_id", "text")
    digests = {"groups_sha256": ("string", groups_sha256)}
    found = alignment.aligned(documents, "text", model_path=PIECE_MODEL, lists=False, derived=digests, **BYTE_BPE)
    scored = alignment.scored(found)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op13_whitened_embeddings(spark, sf):
    """Every vector on the 16 leading components of unit spread."""
    rows = read(spark, sf, "embeddings").select("vec_id", "embedding")
    found = whitening.whitened(rows, "embedding", COMPONENTS)
    columns = ["vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error"]
    return found.select(*columns)
