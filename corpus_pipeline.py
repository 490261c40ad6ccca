"""The corpus pipeline: documents in, a weighted training mix out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from daygrain.llm import decontamination, exact_dedup, mixing, simhash, toxicity
from daygrain.session import stored

Docs = DataFrame


def drop_toxic(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Keep the documents that score below the threshold; labels of the held-out third are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out_col="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def drop_copies(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Of equal texts the longest stays, then the smallest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Of documents whose fingerprints link, the one with the smallest id stays."""
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources repeated to their weight; columns ``epoch`` and ``mix_key``."""
    return mixing.mix(docs, min_entropy=MIN_ENTROPY, max_repetition=MAX_REPETITION)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies),
          ("decontamination", drop_contaminated), ("mixing", mix_sources)]

MIN_ENTROPY, MAX_REPETITION = 0.95, 2.0

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
