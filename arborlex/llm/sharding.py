"""Minimax contiguous partition of documents into shards.

Documents of equal text form an atomic group; groups are ordered by the SHA-256
of their text.  The smallest capacity at which a greedy pass over the groups
needs no more than the given number of shards is found by binary search, and
the order is cut there.  The law that holds is ``bytes``: sizes near equal.

The driver never sees the groups.  It holds segments: the sums of all groups
whose hash starts with the same bits, at most 65,536 of them at first.  A
greedy pass over segments brackets the true cuts (hopeful: a segment that fits
in part is taken whole; pessimistic: it is left to the next shard).  Only
segments in which a cut may fall are split, 16-fold, until every cut falls on
a single group; so each step fetches a bounded number of rows, whatever the
number of groups.  A document's shard then follows from its own hash and the
shards' first keys; no join is needed.

Slots number a shard's documents without gaps: documents are dealt by hash of
(doc_id, text) over a bounded number of bins per shard, bins are numbered in a
window each, and start where the bins before them end.  A group of copies
spreads over the bins, so no window holds more than a bin.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .workspace import Workspace, fresh

FIRST, STEP = 4, 1  # hexadecimal digits of the segments' prefixes, and of each split
PER_BIN, MOST_BINS = 50_000, 4096  # documents in a bin, about; bins of a shard at most
OVERHEAD = 16


def _raw() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def _greedy(sums: list[int], single: list[bool], shards: int, capacity: int, hopeful: bool) -> list[int]:
    """For each shard, the segment after its last; more than ``shards`` entries if those don't do.

    hopeful: a segment of several groups of which a part fits goes whole with it; else it's left to the next shard.
    """
    ends, at = [], 0
    while at < len(single) and len(ends) <= shards:
        at = bisect_right(sums, sums[at] + capacity) - 1
        if hopeful and at < len(single) and not single[at]:
            at += 1
        ends.append(at)
    return ends


def _smallest(low: int, high: int, ok) -> int:
    while low < high:
        mid = (low + high) // 2
        if ok(mid):
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """First keys of the shards after the first, and the capacity, for groups (key, size long above 0).

    A hopeful pass never ends a shard before the exact pass does, a pessimistic one never after it;
    so the least capacities at which they do bracket the true one, and the cuts.
    """
    prefix = lambda n: F.substring("key", 1, n).alias("p")
    fold = (F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").cast("long").alias("top"))
    segments = sorted(tuple(r) for r in groups.groupBy(prefix(FIRST)).agg(*fold).collect())
    if not segments:
        return [], 0
    total, top = sum(s[1] for s in segments), max(s[3] for s in segments)
    least = max(top, -(-total // shards))
    while True:
        single = [s[2] == 1 for s in segments]
        sums = [0, *accumulate(s[1] for s in segments)]
        # segments that are large against a shard hold its cuts whatever they are; there are few
        doubt = {i for i, s in enumerate(segments) if not single[i] and 8 * s[1] > least}
        if not doubt:
            fits = lambda c, hopeful: len(_greedy(sums, single, shards, c, hopeful)) <= shards  # noqa: B023, E731
            low = _smallest(least, total, lambda c: fits(c, True))
            high = _smallest(low, total, lambda c: fits(c, False))
            first, last = _greedy(sums, single, shards, low, False)[:shards], _greedy(sums, single, shards, high, True)
            last += [len(single)] * (len(first) - len(last))
            doubt = {i for a, b in zip(first, last, strict=False) for i in range(a, b) if not single[i]}
            if not doubt:
                return [segments[i][0] for i in first if i < len(segments)], low
        finer = []
        for n in sorted({len(segments[i][0]) for i in doubt}):
            own = [(segments[i][0],) for i in sorted(doubt) if len(segments[i][0]) == n]
            inside = groups.join(F.broadcast(groups.sparkSession.createDataFrame(own, "p string")), F.substring("key", 1, n) == F.col("p"), "left_semi")
            finer += [tuple(r) for r in inside.groupBy(prefix(n + STEP)).agg(*fold).collect()]
        segments = sorted([s for i, s in enumerate(segments) if i not in doubt] + finer)


def shard(docs: DataFrame, shards: int = 40, ws: Workspace | None = None) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (null: the law isn't ``key``).

    Columns of docs with these names are replaced, all others stay.  Null texts are empty.  A shard may stay empty if
    there are fewer groups than shards.
    """
    ws = ws or Workspace(docs.sparkSession, "sharding")
    own = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    key, bin_, before, within = fresh([*own.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "key", "bin", "before", "within")
    rows = own.withColumns({"size": F.octet_length(_raw()).cast("long") + OVERHEAD, "text_crc32": F.crc32(_raw()).cast("long"), key: F.sha2(_raw(), 256)})
    groups = ws.save(rows.groupBy(F.col(key).alias("key")).agg(F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    cuts, _ = minimax_cuts(groups.select("key", "size"), shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col(key) >= F.lit(c)).cast("int")
    count = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, min(MOST_BINS, count // shards // PER_BIN))
    placed = rows.withColumns({"shard": number.cast("int"), bin_: F.pmod(F.xxhash64("doc_id", key), F.lit(bins)).cast("int")})
    starts = placed.groupBy("shard", bin_).agg(F.count(F.lit(1)).alias("many"))
    running = F.coalesce(F.sum("many").over(Win.partitionBy("shard").orderBy(bin_).rowsBetween(Win.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("shard", bin_, running.alias(before))  # at most shards x MOST_BINS rows
    place = F.row_number().over(Win.partitionBy("shard", bin_).orderBy(key, "doc_id"))
    out = placed.withColumn(within, place).join(F.broadcast(starts), ["shard", bin_])
    out = out.withColumns({"slot": (F.col(before) + F.col(within) - 1).cast("long"), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return out.select(*own.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
