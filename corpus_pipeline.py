"""The corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage works on all that the one before kept, as read back from Parquet;
all but the last return the columns of ``documents``.

Defined results: null, empty and blank texts aren't toxic and are near
duplicates of each other, so one of them stays, and from the third stage on
its text is not null; repeated rows are near duplicates too, and of equal
``doc_id`` the first row stays; a null ``doc_id`` stays only if none of its
group has one; very long texts are worked on whole; extra columns are dropped;
an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodekey.llm import packing, simhash, staging, suffixes, toxicity

PASSAGE_WORDS = 51
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), staging.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares four fifths of its five-word shingles."""
    return simhash.one_per_component(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words that occur elsewhere out of the texts; every row stays."""
    kept = suffixes.remove_passages(docs, ["doc_id", "lang", "source"], PASSAGE_WORDS)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None  # SQL can't express the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staging.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staging.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
