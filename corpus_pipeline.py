"""From raw documents to a mixed and sharded training corpus, by the operators of ``arborlex.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlex.llm import crf, decontaminate, mixing, sharding, simhash
from arborlex.llm.queries import table
from arborlex.llm.workspace import Workspace, releasing

#: Classifier, SimHash and the hash-free mix have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity reaches 0.3, by a model learned from the labelled documents among docs."""
    return crf.remove_toxic(docs, docs, table(spark, sf_dir, "labels"), mod=4, rest=2, threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs, k=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mix(docs, share=1.5, most=2.0, weights=(3, 1, 2), seed=42)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Forty shards of nearly equal bytes; equal texts stay together."""
    return sharding.shard(docs, shards=40)


STAGES = [("toxicity", toxicity), ("simhash_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with releasing():
            docs = ws.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            ws.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
