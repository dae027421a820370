"""The graph as DataFrames, and how it is built from extractor output.

Spans decide everything.  Symbols are numbered by (start, end descending,
order of emission), tokens by start; an item's parent is the symbol with the
largest number that starts at or before it and ends after its start.  For
valid spans that equals the innermost open symbol of a left-to-right sweep.
The sweep runs per file inside an Arrow function (:func:`arrange`);
:func:`containment` is the same relation with window functions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C

FILE_KEY = ["org", "repo", "path"]


@dataclass(frozen=True)
class Graph:
    files: DataFrame
    symbols: DataFrame
    tokens: DataFrame
    postings: DataFrame | None = None
    catalog: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def with_derived(self) -> Graph:
        """The graph with postings and catalog; both are aggregations of the base tables."""
        out = replace(self, postings=postings(self))
        return replace(out, catalog=catalog(out))

    def only(self, condition) -> Graph:
        """Every table restricted by a condition on org and repo."""
        part = lambda df: df.where(condition) if df is not None else None
        return Graph(part(self.files), part(self.symbols), part(self.tokens), part(self.postings), part(self.catalog))


class SpanError(ValueError):
    """Spans that cross, or end before they start."""


def check_nesting(symbols: list[dict], tokens: Iterable[dict]) -> None:
    """Raises if a span ends before it starts, or an item ends after the innermost symbol that is open at its start."""
    items = [(s["start"], -s["end"], 0, s["end"]) for s in symbols] + [(t["start"], 0, 1, t["end"]) for t in tokens]
    open_ends: list[int] = []
    for start, _, is_token, end in sorted(items):
        if start > end:
            raise SpanError(f"a span starts at {start} and ends at {end}")
        while open_ends and open_ends[-1] <= start:
            open_ends.pop()
        if open_ends and end > open_ends[-1]:
            raise SpanError(f"a span from {start} to {end} crosses one that ends at {open_ends[-1]}")
        if not is_token and end > start:
            open_ends.append(end)


def arrange(symbols: list[dict], tokens: list[dict]) -> tuple[list[dict], list[dict]]:
    """Numbers, parents, depths, chains, qualified names and token ranges for one file's declarations."""
    symbols = sorted(symbols, key=lambda s: (s["start"], -s["end"]))  # stable: equal spans keep their order
    tokens = sorted(tokens, key=lambda t: t["start"])
    out: list[dict] = []
    stack: list[int] = []
    for i, s in enumerate(symbols):
        while stack and symbols[stack[-1]]["end"] <= s["start"]:
            stack.pop()
        up = out[stack[-1]] if stack else None
        own = {"sidx": i, "name": s["name"], "kind": s["kind"], "lang_kind": s.get("lang_kind"), "owner": s.get("owner")}
        out.append({**s, **own, "parent_sidx": up["sidx"] if up else None, "depth": len(stack), "chain": [own, *(up["chain"] if up else [])], "qualified": f"{up['qualified']}::{s['name']}" if up else s["name"], "first_tok": None, "last_tok": None})
        if s["end"] > s["start"]:
            stack.append(i)
    parents = enclosing(out, [t["start"] for t in tokens])
    return out, [{**t, "ordinal": n, "parent_sidx": p} for n, (t, p) in enumerate(zip(tokens, parents, strict=True))]


def enclosing(symbols: list[dict], starts: list[int]) -> list[int | None]:
    """For each of the ascending start bytes, the number of the innermost symbol around it.

    symbols are arranged already; their token ranges are filled in.
    """
    if not symbols:
        return [None] * len(starts)
    out, at, stack = [], 0, []
    for n, start in enumerate(starts):
        while at < len(symbols) and symbols[at]["start"] <= start:
            while stack and symbols[stack[-1]]["end"] <= symbols[at]["start"]:
                stack.pop()
            if symbols[at]["end"] > symbols[at]["start"]:
                stack.append(at)
            at += 1
        while stack and symbols[stack[-1]]["end"] <= start:
            stack.pop()
        for k in stack:
            if symbols[k]["first_tok"] is None:
                symbols[k]["first_tok"] = n
            symbols[k]["last_tok"] = n
        out.append(stack[-1] if stack else None)
    return out


def containment(symbols: DataFrame, items: DataFrame, key: list[str], item: str) -> DataFrame:
    """(key, item, parent_sidx): the innermost symbol around each item, in one pass over a file's events by place.

    A symbol's start opens a level and its end closes it; an item belongs to the last symbol that opened the level it
    is on.  One shuffle by file, two sorts, and never more rows than symbols and items together.
    """
    none = F.lit(None)
    at = lambda df, pos, rank, tie, sidx, level, what: df.select(*key, pos.alias("pos"), F.lit(rank).alias("rank"), tie.cast("bigint").alias("tie"), sidx.cast("int").alias("sidx"), F.lit(level).alias("level"), what.alias("item"))
    kind = items.schema[item].dataType
    spans = symbols.where(F.col("start") < F.col("end"))
    events = (
        at(spans, F.col("start"), 1, -F.col("end"), F.col("sidx"), 1, none.cast(kind))
        .unionByName(at(spans, F.col("end"), 0, none, none, -1, none.cast(kind)))
        .unionByName(at(items, F.col("start"), 2, none, none, 0, F.col(item)))
    )
    order = ("pos", "rank", "tie", "sidx")
    until_here = Win.partitionBy(*key).orderBy(*order).rowsBetween(Win.unboundedPreceding, 0)
    on_level = Win.partitionBy(*key, "depth").orderBy(*order).rowsBetween(Win.unboundedPreceding, 0)
    placed = events.withColumn("depth", F.sum("level").over(until_here)).withColumn("opener", F.last("sidx", ignorenulls=True).over(on_level))
    return placed.where("rank = 2").select(*key, F.col("item").alias(item), F.when(F.col("depth") > 0, F.col("opener")).alias("parent_sidx"))


def postings(g: Graph) -> DataFrame:
    """(text, org, repo, path, language, encoding, lossy, count): enough for every roll-up that only counts."""
    counted = g.tokens.groupBy("text", *FILE_KEY).agg(F.count(F.lit(1)).alias("count"))
    return counted.join(g.files.select(*FILE_KEY, "language", "encoding", "lossy"), FILE_KEY).select(*S.POSTINGS.names)


def catalog(g: Graph) -> DataFrame:
    """Counters in long form: what is files, symbols, tokens, symbol_kind, token_class, encoding or lossy."""
    by = ["org", "repo", "language"]
    files = g.files.groupBy(*by).agg(F.count(F.lit(1)).alias("count")).select(*by, F.lit("files").alias("what"), F.lit("").alias("label"), "count")
    # one pass over symbols and one over tokens: the totals come from the labels' counts
    kinds = g.symbols.groupBy(*by, C.kind_label(F.col("kind"), F.col("lang_kind")).alias("label")).agg(F.count(F.lit(1)).alias("count")).select(*by, F.lit("symbol_kind").alias("what"), "label", "count")
    classes = g.tokens.groupBy(*by, F.col("class").alias("label")).agg(F.count(F.lit(1)).alias("count")).select(*by, F.lit("token_class").alias("what"), "label", "count")
    coded = g.files.where(F.col("encoding") != "UTF-8").groupBy(*by, F.col("encoding").alias("label")).agg(F.count(F.lit(1)).alias("count")).select(*by, F.lit("encoding").alias("what"), "label", "count")
    lossy = g.files.where("lossy").groupBy(*by).agg(F.count(F.lit(1)).alias("count")).select(*by, F.lit("lossy").alias("what"), F.lit("").alias("label"), "count")
    return files.unionByName(kinds).unionByName(classes).unionByName(coded).unionByName(lossy)


def nodes(g: Graph) -> DataFrame:
    """All nodes, one row each, with a key and the parent's key; children sort by ``seq``."""
    org = F.concat(F.lit("org/"), "org")
    repo = F.concat_ws("/", F.lit("repo"), "org", "repo")
    file = F.concat_ws("/", F.lit("file"), "org", "repo", "path")
    sub = lambda tag, n: F.concat(F.lit(f"{tag}/"), F.col(n).cast("string"), F.lit("@"), F.concat_ws("/", "org", "repo", "path"))
    up = F.when(F.col("parent_sidx").isNull(), file).otherwise(sub("symbol", "parent_sidx"))
    none = F.lit(None).cast("string")
    big = F.lit(None).cast("bigint")
    first = g.files.groupBy("org", "repo").agg(F.min("seq").alias("seq"))
    orgs = first.groupBy("org").agg(F.min("seq").alias("seq")).select(org.alias("key"), none.alias("parent"), F.lit("org").alias("kind"), F.col("org").alias("name"), "seq", big.alias("start"), big.alias("end"), "org", none.alias("repo"), none.alias("path"))
    repos = first.select(repo.alias("key"), org.alias("parent"), F.lit("repo").alias("kind"), F.col("repo").alias("name"), "seq", big.alias("start"), big.alias("end"), "org", "repo", none.alias("path"))
    files = g.files.select(file.alias("key"), repo.alias("parent"), F.lit("file").alias("kind"), F.col("path").alias("name"), "seq", big.alias("start"), big.alias("end"), "org", "repo", "path")
    order = lambda is_token, n: F.col("start") * 2 + F.lit(is_token)
    syms = g.symbols.select(sub("symbol", "sidx").alias("key"), up.alias("parent"), F.lit("symbol").alias("kind"), "name", order(0, "sidx").alias("seq"), "start", "end", "org", "repo", "path")
    toks = g.tokens.select(sub("token", "ordinal").alias("key"), up.alias("parent"), F.lit("token").alias("kind"), F.col("text").alias("name"), order(1, "ordinal").alias("seq"), "start", "end", "org", "repo", "path")
    return orgs.unionByName(repos).unionByName(files).unionByName(syms).unionByName(toks)


def numbered(df: DataFrame, key: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Win.partitionBy(*key).orderBy(*order)) - 1).cast("int"))


def invalid_edges(all_nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is missing or of a kind that can't hold them."""
    up = all_nodes.select(F.col("key").alias("parent"), F.col("kind").alias("parent_kind"))
    allowed = C.all_of([F.lit(True)]) & F.lit(False)
    for parent, children in S.CONTAINS.items():
        if children:
            allowed = allowed | ((F.col("parent_kind") == parent) & F.col("kind").isin(*children))
    return all_nodes.where(F.col("kind") != "org").join(up, "parent", "left").where(~F.coalesce(allowed, F.lit(False)))
