"""What the two learned classifiers share: a bounded sample of labelled rows, one training task, calibration."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def held_out(doc_ids: list, mod: int, rest: int) -> np.ndarray:
    """True where crc32 of doc_id as text, modulo mod, is rest (null: as the empty text)."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % mod == rest for x in doc_ids], dtype=bool)


def sample(docs: DataFrame, labels: DataFrame, column: str, mod: int, rest: int, most: int, most_bytes: int, ws: Workspace) -> DataFrame:
    """(doc_id, text, y int): one row for each of at most ``most`` labelled training documents, those with the smallest hashes of doc_id.

    Null labels are skipped; a doc_id that several rows label takes the largest label.  One that several rows of
    docs have is taken once, with its smallest text by code points (null: empty).  In the order of the hashes,
    texts are taken as long as all taken hold no more than ``most_bytes``; one that would exceed that is left out.
    So one training task holds a bounded number of rows and bytes.  The chosen ids are broadcast (16 bytes each).
    """
    spark = docs.sparkSession
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    fit = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (crc % mod != rest))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    there = own.select("doc_id").distinct()
    chosen = fit.groupBy("doc_id").agg(F.max("y").alias("y")).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = spark.createDataFrame(chosen.collect(), "doc_id long, y int")
    rows = ws.save(own.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    left, keep = most_bytes, []
    for r in rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= left:
            left -= r["n"]
            keep.append((r["doc_id"],))
    return rows.join(F.broadcast(spark.createDataFrame(keep, "doc_id long")), "doc_id").select("doc_id", "text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last one constant) of a logistic regression of y on the columns of x, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
