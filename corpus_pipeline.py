"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `docs`. `run` applies them to the documents, written as Parquet between stages.

Every stage handles NULL in any column, empty and very long texts, ties, repeated rows, an empty table and further
columns of any name; what each makes of them is said with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import language_id, line_dedup, packing, secret_scan, simhash
from tablewright.llm.common import written


def _packed(docs: DataFrame) -> DataFrame:
    """key, text and row: all columns in one struct, so that no name of theirs can meet one that an operator uses."""
    return docs.select(F.col("doc_id").alias("key"), F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _unpacked(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again, with `text` as it now is and n_chars, if it is there, its length."""
    now = {"text": F.col("text"), "n_chars": F.length("text")}
    return frame.select(*(now.get(f.name, F.col("row").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema.fields))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language: no text, no letter, or mostly unlike all of them.

    Learns from the documents that are not held out. If none has a language, only those without a letter go.
    """
    spoken = docs.select("doc_id", "text", F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    model = language_id.train(spoken.filter(~language_id.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    told = language_id.predict(_packed(docs), model)
    return _unpacked(told.filter((F.col("lang_pred") != language_id.UND) & (F.col("other") <= 0.5)), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that repeat, or nearly repeat, an earlier one. n_chars follows the text.

    Every document stays, also one that has lost all its lines. NULL text stays NULL.
    """
    return _unpacked(line_dedup.dedup(_packed(docs), "key", "text"), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the least doc_id; of repeated rows, one.

    Documents without a word (NULL text too) have the same fingerprint, zero, so one of them stays.
    """
    return _unpacked(simhash.keep_one(_packed(docs), "key", "text"), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows the text. Every document stays."""
    found = secret_scan.findings(_packed(docs), "text")
    return _unpacked(found.withColumn("text", secret_scan.masked(F.col("text"), F.col("findings"))), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of 2048 tokens; a row per piece. NULL text is empty: its end id only."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs, "doc_id", "text", path, public_tokenizers.PATTERN, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the learned stage nor the tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
