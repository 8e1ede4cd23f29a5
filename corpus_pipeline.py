"""Corpus pipeline: ``documents`` through the training-data operators, stage by stage.

Each stage gets the rows its predecessor kept and returns the columns of
``documents`` (the last one adds the encoding).  ``run`` writes every stage as
Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmodes.llm import contamination, pieces, quality, simhash, substring
from fieldmodes.llm.tables import documents, free_name, keep, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled rules reject go."""
    prepare(spark)
    return quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, the one with the smallest id."""
    prepare(spark)
    return simhash.keep_one_per_component(docs, width=4, max_bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a window of 20 words seen earlier covers are cut out of the texts.

    ``n_chars`` follows the text; a document that loses all its words goes."""
    prepare(spark)
    count = free_name(docs, "n_removed")
    out = substring.substring_dedup(docs, window=20, count_col=count)
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col(count) > 0
    return (out.where(~changed | left).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage (13 words, at most 2 substituted) go."""
    prepare(spark)
    return contamination.keep_clean(docs, documents(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their text (``ids``), their number (``n_tokens``), and whether they decode to the text
    (``round_trip``); a name that a column of the documents has gets ``_`` behind it."""
    prepare(spark)
    ids, decoded, n_tokens, round_trip = (free_name(docs, c) for c in ("ids", "decoded", "n_tokens", "round_trip"))
    out = pieces.decode(pieces.encode(docs, out_col=ids), ids_col=ids, out_col=decoded)
    return out.select(*[F.col(f"`{c}`") for c in (*docs.columns, ids)], F.size(ids).cast("long").alias(n_tokens),
                      F.col(decoded).eqNullSafe(F.col("text")).alias(round_trip))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", simhash_near_dedup), ("substring dedup", substring_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("SentencePiece", sentencepiece)]
#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
