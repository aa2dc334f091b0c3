"""Corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. The first four return the columns of documents and no others, whatever more
their input has; the last returns a row per packed piece. Empty tables pass through
as empty, repeated rows are judged each for itself but by near-dedup. run() writes each stage's result as Parquet in the shared folder
and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import decontaminate, language_id, near_dup, packing, suffix_dedup
from lodeweave.llm.common import read_table, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told; those without a letter (`und`) go.

    Trained on docs' own text and non-null lang. lang is filled in where it is null."""
    model = language_id.fit(docs)
    out = language_id.predict(docs.select(*COLUMNS), model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (shingles of five words, similarity 0.8).

    Of rows that repeat that doc_id one stays. Null, empty and wordless texts are no
    duplicates of anything; a null doc_id stays only if all its group has none."""
    return near_dup.keep_one(docs, shingle=5, percent=80).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of at least 50 words that occur again; n_chars follows. Emptied documents stay, as ''.

    Passages are runs of 200-byte strings that recur: 50 words of three letters and a
    blank. All copies go, as of strings in op6. Null texts stay null."""
    return suffix_dedup.clean(docs, length=200, min_words=50).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items. Null and empty texts hold none; with an empty benchmark all stay."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset. A null text is empty, an empty one is one piece (its end mark)."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]
ORACLE_SQL = None  # kernels, sketches and tokenizers have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
