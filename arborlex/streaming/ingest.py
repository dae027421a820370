"""Streaming ingest: files that appear in a folder, or rows of any stream, upserted batch by batch.

Exactly once: the store's manifest keeps the last batch of each stream, and a
replayed batch does nothing.  Back-pressure is the source's: maxFilesPerTrigger
or maxBytesPerTrigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def folder_stream(spark: SparkSession, folder: str, org: str, repo: str, max_files: int = 1000) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    base = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.expr(f"substring(path, locate('{base}', path) + {len(base) + 1})")
    return raw.select(F.lit(org).alias("org"), F.lit(repo).alias("repo"), rel.alias("path"), "content", F.lit("directory").alias("origin"), F.unix_micros("modificationTime").alias("seq"))


def ingest(files: DataFrame, store: Store, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream; with ``once`` it ends when what is there now has been read."""

    def batch(df: DataFrame, batch_id: int) -> None:
        store.upsert(df, stream=(name, batch_id))

    writer = files.writeStream.queryName(name).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what a stream of versions leaves in a store."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("last")).select(*key, "last.*")
