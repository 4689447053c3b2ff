"""Corpus pipeline: quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined cases are those of the operators. A document that loses words in the third
stage has the kept words joined by one space as its text, and their number of
characters as n_chars; one that loses all its words stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import near_dedup, packing, quality, substring_dedup
from tessella.llm.common import cut, table
from tessella.llm.queries import pieces_digest, sites, tokenizer


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), *sites(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words a shingle, similarity 0.8 or more) the one with the smallest id stays."""
    return near_dedup.keep_one(docs, words=5, threshold_percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id has are cut out."""
    # the documents' own columns are one, whatever their names are
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    kept = substring_dedup.remove_repeats(docs.select("doc_id", "text", own))
    less = F.col("n_removed") > 0
    changed = {"text": F.when(less, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(less, F.length("kept_text")).otherwise(F.col("_row.n_chars"))}
    return kept.select(*[(changed[c].cast(docs.schema[c].dataType) if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row for each piece."""
    return pieces_digest(packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=1))


STAGES = [("quality classifier", good_documents), ("near-duplicates", without_near_copies), ("substring dedup", without_repeats), ("packing", packed)]
#: The classifier's fit, MinHash and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
