"""A training-corpus pipeline over ``documents``: each stage's output is written and read again by the next.

Stages: language identification (rows without a recognisable language go), near-duplicates (one row of smallest id
of each class stays), repeated byte strings (cut out; emptied documents go), benchmark decontamination (hit documents
go), packing.  No SQL can express them, so the tests hold them against brute force.

Null, empty and letterless texts go in the first stage.  Rows of null or equal ids are judged by their texts.  Texts of
any length are read whole.  Repeated rows are near-duplicates, of which one stays.  An empty table gives an empty one.
Further columns of ``documents`` are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, near_dedup, packing, suffix_dedup
from tidemark.llm.common import held_out, kept_names, staged

#: Text of a bucket and of a group of documents in the third stage, whose workers share executors with all that earlier ones left.
BUCKET_BYTES, GROUP_BYTES = 8 << 20, 6 << 20

#: Predictions below this probability count as rejected, too.
MIN_SCORE = 0.5


def _restored(docs: DataFrame, found: DataFrame, results: tuple[str, ...]) -> DataFrame:
    """The columns of docs, which an operator has carried beside its results."""
    names = kept_names(docs.columns, results)
    return found.select(*(F.col(f"`{names[c]}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has a recognisable language; a missing lang is filled with it."""
    rows = language.identify_languages(docs, ~held_out("doc_id", 4, 2), keep=tuple(docs.columns))
    known = rows.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return _restored(docs, known.withColumn("lang", F.coalesce("lang", "lang_pred")), language.RESULTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, of smallest id."""
    return near_dedup.one_of_each_class(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes or more that a document of smaller id has."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = suffix_dedup.remove_repeats(docs, keep=others, kept_text=True, bucket_bytes=BUCKET_BYTES, group_bytes=GROUP_BYTES).filter("n_removed = 0 or length(trim(kept_text)) > 0")
    names = kept_names(["doc_id", "text", *others], suffix_dedup.RESULTS)
    length = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(names["n_chars"])).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("kept_text"), "n_chars": length}
    return out.select(*(new.get(c, F.col(f"`{names[c]}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns))
    return _restored(docs, found.filter("not contaminated"), (*decontaminate.RESULTS, "spans"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
