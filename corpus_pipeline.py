"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), with the columns of ``documents``, and works on all that the stage before it
kept; all but the last return the same columns. Near-duplicates are found on five-word shingles at a
similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from tallyframe.llm._shared import BLANKS, materialize, read_table
from tallyframe.llm.queries import held_out, vocabulary_path

#: SQL can express neither the toxicity scores nor the ids; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go; learns as the query does, from rows that are not held out."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id", 4))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the largest id only; documents that lose all their text go."""
    out = line_dedup.dedup_lines(docs)
    kept = out.where((F.col("n_dropped") == 0) | (F.btrim("kept_text", F.lit(BLANKS)) != ""))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))
    chars = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    new = {"text": text, "n_chars": chars}
    return kept.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return near_dup.drop_near_duplicates(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 5 % of their words in benchmark windows go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), remove="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of what is left; ids as little-endian 32-bit integers."""
    return bpe.round_trip(docs, vocabulary_path()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
