"""Queries that lex and extract the sample sources of every language, one file for each nation; SQL states the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.build import graph_of, prepare
from .plans.graph import Graph
from .samples import SAMPLES, Sample
from .sources import tables as TB


def _sql(value: str | int | None) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


def _tokens_sql(sample: Sample) -> str:
    """Common table t: every token of every nation's file with its ordinal and exact place, from what stands before it."""
    rows = [(n, gap, text, cls) for n, (gap, text, cls) in enumerate(sample.tokens()[:-1])]
    put = lambda c: f"replace({c}, '{{k}}', CAST(n_nationkey AS VARCHAR))"
    return f"""e(n, gap, text, class) AS (VALUES {_values(rows)}),
 f AS (SELECT n_nationkey AS k, n, gap, {put("text")} AS text, class FROM e, nation),
 g AS (SELECT k, n, text, class, coalesce(string_agg(gap||text, '') OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')||gap AS before FROM f),
 t AS (SELECT k, n, text, class, CAST(octet_length(encode(before)) AS BIGINT) AS start, CAST(octet_length(encode(before||text)) AS BIGINT) AS stop, CAST(1+length(before)-length(replace(before, chr(10), '')) AS BIGINT) AS start_line, CAST(1+length(regexp_extract(before, '[^\\n]*$')) AS BIGINT) AS start_col,
  CAST(1+length(before||text)-length(replace(before||text, chr(10), '')) AS BIGINT) AS end_line, CAST(1+length(regexp_extract(before||text, '[^\\n]*$')) AS BIGINT) AS end_col FROM g)"""


def _graph(spark: SparkSession, sf: str, sample: Sample) -> Graph:
    key = F.col("n_nationkey").cast("string")
    content = F.replace(F.lit(sample.source()), F.lit("{k}"), key)
    files = TB.table(spark, sf, "nation").select(F.lit("samples").alias("org"), F.lit("r").alias("repo"), F.concat(F.lit("f"), key, F.lit(f".{sample.extension}")).alias("path"), content.cast("binary").alias("content"))
    return graph_of(prepare(files))


def _key() -> F.Column:
    return F.regexp_extract("path", r"f(\d+)\.", 1).cast("int").alias("k")


def _tokens(language: str):
    sample = SAMPLES[language]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _graph(spark, sf, sample).tokens.where(F.col("language") == language).select(_key(), F.col("ordinal").cast("int").alias("ordinal"), "text", "class", "start", "end", "start_line", "start_col", "end_line", "end_col")

    return run, f'WITH {_tokens_sql(sample)} SELECT k, n AS ordinal, text, class, start, stop AS "end", start_line, start_col, end_line, end_col FROM t'


def _symbols(language: str):
    sample = SAMPLES[language]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _graph(spark, sf, sample).symbols.where(F.col("language") == language).select(_key(), "name", "kind", "lang_kind", "owner", "start", "end", F.size("chain").cast("bigint").alias("chain_length"))

    rows = [(i, *s) for i, s in enumerate(sample.symbols())]
    # a symbol's chain is itself and those around it: the spans that hold its own, earlier ones first among equals
    sql = f"""WITH {_tokens_sql(sample)}, d(i, name, kind, lang_kind, owner, a, b) AS (VALUES {_values(rows)}),
 depth AS (SELECT x.i, count(*) AS chain_length FROM d x JOIN d y ON y.a<=x.a AND y.b>=x.b AND (y.i<=x.i OR y.a<x.a OR y.b>x.b) GROUP BY x.i)
 SELECT p.k, replace(name, '{{k}}', CAST(p.k AS VARCHAR)) AS name, kind, lang_kind, replace(owner, '{{k}}', CAST(p.k AS VARCHAR)) AS owner, p.start, q.stop AS "end", chain_length FROM d JOIN depth USING (i) JOIN t p ON p.n=a JOIN t q ON q.n=b AND q.k=p.k"""
    return run, sql


def register(put: Callable[[str, Callable, str], None]) -> None:
    for language in SAMPLES:
        put(f"tokens_{language}", *_tokens(language))
        put(f"symbols_of_{language}", *_symbols(language))
