"""describe, counts, repositories, files, extractor gaps, and checks of filters against what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.graph import Graph, catalog


def _scope(df: DataFrame, org: str | None, repo: str | None) -> DataFrame:
    if org is not None:
        df = df.where(F.col("org") == org)
    return df.where(F.col("repo") == repo) if repo is not None else df


def _totals(counters: DataFrame) -> DataFrame:
    total = lambda what: F.sum(F.when(F.col("what") == what, F.col("count")).otherwise(0)).cast("bigint")
    return counters.groupBy("org", "repo", "language").agg(total("files").alias("files"), total("symbol_kind").alias("symbols"), total("token_class").alias("tokens"))


def describe(g: Graph, org: str | None = None, repo: str | None = None) -> DataFrame:
    """(org, repo, language, files, symbols, tokens) from the stored counters."""
    counters = g.catalog if g.catalog is not None else catalog(g)
    return _totals(_scope(counters, org, repo)).orderBy("org", "repo", "language")


def describe_by_scan(g: Graph, org: str | None = None, repo: str | None = None) -> DataFrame:
    """The same from the base tables."""
    by = ["org", "repo", "language"]
    count = lambda df, name: _scope(df, org, repo).groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    out = count(g.files, "files").join(count(g.symbols, "symbols"), by, "left").join(count(g.tokens, "tokens"), by, "left")
    return out.na.fill(0, ["symbols", "tokens"]).orderBy(*by)


def describe_nested(g: Graph, org: str | None = None, repo: str | None = None) -> DataFrame:
    """A row per repository with maps: languages, token classes, encodings; lossy files and files."""
    counters = _scope(g.catalog if g.catalog is not None else catalog(g), org, repo)
    label = lambda what, value: F.map_from_entries(F.collect_list(F.when(F.col("what") == what, F.struct("label", value))))
    kinds = counters.groupBy("org", "repo", "language").agg(*(F.sum(F.when(F.col("what") == w, F.col("count")).otherwise(0)).alias(n) for w, n in (("files", "files"), ("symbol_kind", "symbols"), ("token_class", "tokens"))), label("symbol_kind", F.col("count")).alias("symbol_kinds"))
    languages = kinds.groupBy("org", "repo").agg(F.sum("files").alias("files"), F.map_from_entries(F.collect_list(F.struct("language", F.struct("files", "symbols", "tokens", "symbol_kinds")))).alias("languages"))
    summed = counters.where("what in ('token_class', 'encoding', 'lossy')").groupBy("org", "repo", "what", "label").agg(F.sum("count").alias("count"))
    more = summed.groupBy("org", "repo").agg(label("token_class", F.col("count")).alias("token_classes"), label("encoding", F.col("count")).alias("encodings"), F.sum(F.when(F.col("what") == "lossy", F.col("count")).otherwise(0)).alias("lossy"))
    return languages.join(more, ["org", "repo"], "left").orderBy("org", "repo")


def labels(g: Graph, what: str) -> DataFrame:
    """(org, repo, label, count) of one kind of counter."""
    counters = g.catalog if g.catalog is not None else catalog(g)
    return counters.where(F.col("what") == what).groupBy("org", "repo", "label").agg(F.sum("count").alias("count"))


def count_nodes(g: Graph) -> DataFrame:
    """(kind, count)."""
    f = g.files.agg(F.countDistinct("org").alias("org"), F.countDistinct("org", "repo").alias("repo"), F.count(F.lit(1)).alias("file"))
    f = f.select(F.explode(F.create_map(*(x for k in ("org", "repo", "file") for x in (F.lit(k), F.col(k))))).alias("kind", "count"))
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(kind).alias("kind"), "count")
    return f.unionByName(one(g.symbols, "symbol")).unionByName(one(g.tokens, "token"))


def list_repos(g: Graph, org: str | None = None) -> DataFrame:
    return _scope(g.files, org, None).select("org", "repo").distinct().orderBy("org", "repo")


def list_files(g: Graph, org: str, repo: str, prefix: str = "") -> DataFrame:
    return _scope(g.files, org, repo).where(F.col("path").startswith(prefix)).orderBy("path")


def file_outline(g: Graph, org: str, repo: str, path: str) -> DataFrame:
    """A file's symbols in source order, the longer first where two start together."""
    return _scope(g.symbols, org, repo).where(F.col("path") == C.normalize_path(F.lit(path))).orderBy("start", F.desc("end"), "sidx")


def file_tokens(g: Graph, org: str, repo: str, path: str, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
    rows = _scope(g.tokens, org, repo).where(F.col("path") == C.normalize_path(F.lit(path)))
    if start_line is not None:
        rows = rows.where(F.col("start_line") >= start_line)
    if end_line is not None:
        rows = rows.where(F.col("start_line") <= end_line)
    return rows.orderBy("ordinal")


def extractor_gaps(g: Graph, registered: list[str]) -> DataFrame:
    """Languages that have symbols but no registered extractor: (org, repo, language, files, symbols)."""
    have = g.spark.createDataFrame([(x,) for x in registered], "language string")
    return describe(g).where("symbols > 0").join(F.broadcast(have), "language", "left_anti").select("org", "repo", "language", "files", "symbols")


NAMED = 50  # values that a refusal lists


def check_filters(g: Graph, language: str | None = None, org: str | None = None, repo: str | None = None, kind: str | None = None) -> None:
    """Raises for a filter value that nothing has, naming the first NAMED of those that there are."""
    counters = g.catalog if g.catalog is not None else catalog(g)

    def refuse(what: str, value: str, values: DataFrame) -> None:
        known = [r[0] for r in values.distinct().orderBy(values.columns[0]).limit(NAMED + 1).collect()]
        raise ValueError(f"no {what} {value!r}; there are: {', '.join(known[:NAMED])}{', ...' if len(known) > NAMED else ''}")

    for column, value in (("language", language and language.lower()), ("org", org), ("repo", repo)):
        if value is not None and counters.where(F.col(column) == value).isEmpty():
            refuse(column, value, counters.select(column))
    if kind is not None:
        kinds = counters.where("what = 'symbol_kind'").select(F.explode(F.split("label", "/")).alias("kind"))
        if kinds.where(F.lower("kind") == kind.lower()).isEmpty():
            refuse("symbol kind", kind, kinds)


def dictionary(g: Graph) -> DataFrame:
    """(text, files, count) of every term."""
    return g.postings.groupBy("text").agg(F.count(F.lit(1)).alias("files"), F.sum("count").cast("bigint").alias("count"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not the other, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


