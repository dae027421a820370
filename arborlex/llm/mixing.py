"""Mixing sources to target weights, with DataFrame functions only.

Tokens are added up by source; each source's repetition rate is its target
over its tokens.  A document is emitted floor(rate) times and once more with
the fraction as probability, by a draw that is a hash of the seed and its
doc_id, so reruns agree.

Targets share ``share`` times all tokens by weight; none exceeds ``most``
times its source's tokens, and the excess is reshared by weight until none is
above.  That fixed point is min(cap, level * weight): with sources ordered by
cap / weight, the level is the first at which the capped ones and the rest add
up, found by running sums over one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .workspace import fresh

WEIGHTS = (3, 1, 2)  # by the sources' code-point order, repeating


def n_words(text: Column) -> Column:
    """The number of maximal runs outside \\x20 and \\x09-\\x0D; null: none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]++")).cast("long")


def source_targets(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size long, target double), a row per source; docs has source and size.

    Sources are ordered by code point, null last.  A source without tokens has target 0.
    """
    own = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Win.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Win.orderBy(F.lit(1)).rowsBetween(Win.unboundedPreceding, Win.unboundedFollowing)
    by_ratio = Win.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Win.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, Win.unboundedFollowing)
    own = own.withColumns({
        "goal": F.sum("source_size").over(everything) * F.lit(float(share)),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(from_here),
    })
    # the level if all sources before this one are capped and none from here on; the first that
    # fits is right, and those after it cap more and are lower
    level = (F.col("goal") - F.col("capped")) / F.col("rest")
    fits = level * F.col("weight") <= F.col("cap")
    level = F.coalesce(F.max(F.when(fits, level)).over(everything), F.lit(float("inf")))
    return own.withColumn("level", level).select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def draw(seed: int, doc_id: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of seed and doc_id (null: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


_ADDED = ("size", "source_size", "target", "copies")


def _rated(docs: DataFrame, names: list[str], share: float, most: float, weights: tuple, seed: int) -> DataFrame:
    """docs with four more columns, named ``names``: size, source_size, target and copies."""
    size, source_size, target, times = names
    (source,) = fresh([*docs.columns, *names], "mix_source")
    rows = docs.withColumn(size, n_words(F.col("text").cast("string")))
    targets = source_targets(rows.select("source", F.col(size).alias("size")), share, most, weights).select(F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target))
    both = rows.join(targets, rows["source"].eqNullSafe(targets[source])).drop(source)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    return both.withColumn(times, (F.floor(rate) + (draw(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")).cast("long"))


def copies(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 42) -> DataFrame:
    """docs with size, source_size, target and copies (long): how often the mix takes each row.

    The sources' table is broadcast if Spark sees that it is small, else joined by shuffle with large
    keys split.  Equal doc_ids get equal draws.  Columns of docs with these names are replaced.
    """
    return _rated(docs.drop(*_ADDED), list(_ADDED), share, most, weights, seed)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 42) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs.

    Null texts have no words but are drawn like any other; rows with equal doc_ids, null ones too, get equal draws;
    repeated rows are taken as often as they come.
    """
    *names, again = fresh(docs.columns, *_ADDED, "again")
    rated = _rated(docs, names, share, most, weights, seed)
    times = F.when(F.col(names[3]) > 0, F.array_repeat(F.lit(0), F.col(names[3]).cast("int")))
    return rated.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(times).alias(again)).drop(again)
