"""Cross-site boilerplate lines by distinct-site spread, with DataFrame functions only.

Each line's hash gathers a HyperLogLog sketch of the sites it occurs on;
sketches merge by aggregation, so a line that a third of all rows share moves
one sketch per task.  A line whose estimate is far from the threshold is
decided by it; near the threshold (within ``margin`` of it either way) the
distinct sites are counted exactly, for those lines only.  Lines on at least
``least`` sites go, from every document.

Lines are cut at ``\\n``, trimmed of spaces and compared whole by two 64-bit
hashes; blank lines are never boilerplate.  A null site is a site of its own;
null texts have no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

LG_K = 10
#: Times the relative standard error of a sketch of 2**LG_K entries; an estimate this far off decides.
SURE = 6


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def boilerplate(lines: DataFrame, least: int) -> DataFrame:
    """(h1, h2, sites) of the lines on at least ``least`` sites; lines has h1, h2 and site."""
    error = SURE * 1.04 / (1 << LG_K) ** 0.5
    low, high = least * (1 - error), least * (1 + error)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = spread.where(F.col("estimate") >= F.lit(low)).select("h1", "h2", "estimate", (F.col("estimate") <= F.lit(high)).alias("near"))
    return spread


def remove_boilerplate(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text), a row for each of docs (doc_id, text, source).

    Rows with equal doc_ids share the set of lines to remove, which holds boilerplate only, so they don't disturb each other.
    """
    ws = Workspace(docs.sparkSession, "lines")
    raw = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("site"))
    return _strip(raw, ws, least)


def _strip(raw: DataFrame, ws: Workspace, least: int) -> DataFrame:
    line = F.explode(F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), lambda x: F.trim(x)), lambda x: x != ""))).alias("line")
    hashed = raw.select("doc_id", "site", line).select("doc_id", "site", _key(F.col("line")).alias("k")).select("doc_id", "site", "k.h1", "k.h2")
    spread = ws.save(boilerplate(hashed.select("h1", "h2", "site"), least), "spread")
    near = spread.where("near").select("h1", "h2")
    exact = hashed.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= least).select("h1", "h2")
    bad = ws.save(spread.where(~F.col("near")).select("h1", "h2").unionByName(exact), "bad")
    hit = hashed.join(bad, ["h1", "h2"], "left_semi").groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    return _apply(raw.join(hit, raw.doc_id.eqNullSafe(hit.hit_id), "left"))


def _apply(both: DataFrame) -> DataFrame:
    every = lines_of(F.col("text"))
    gone = F.coalesce(F.col("gone"), F.array().cast("array<struct<h1:bigint,h2:bigint>>"))
    kept = F.when(F.size(gone) == 0, every).otherwise(F.filter(every, lambda x: ~F.array_contains(gone, _key(x))))
    out = both.select("doc_id", F.size(every).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))
