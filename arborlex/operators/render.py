"""Results as text lines or JSON lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import kind_label


def _place() -> Column:
    return F.concat_ws("/", "org", "repo", "file")


def hits_as_text(hits: DataFrame) -> DataFrame:
    """``org/repo/file:line:col-line:col  symbol  kind  count`` with notes where no symbol was found."""
    span = F.when(F.col("start_line").isNotNull(), F.format_string(":%d:%d-%d:%d", "start_line", "start_col", "end_line", "end_col")).otherwise("")
    note = F.when(F.col("no_symbols"), "(no symbols)").when(F.col("no_matching_symbol"), "(no matching symbol)").otherwise(F.col("symbol"))
    kind = F.when(F.col("symbol_kind").isNotNull(), kind_label(F.col("symbol_kind"), F.col("lang_kind")))
    coded = F.when(F.col("encoding").isNotNull() & (F.col("encoding") != "UTF-8"), F.concat(F.lit("["), "encoding", F.when(F.col("lossy"), ", lossy").otherwise(""), F.lit("]")))
    return hits.select(F.concat_ws("  ", F.concat(_place(), span), note, kind, "token_class", F.concat(F.lit("x"), F.col("count").cast("string")), coded).alias("value"))


def symbols_as_text(hits: DataFrame) -> DataFrame:
    """``org/repo/file:line:col  qualified  kind`` at the declaration's name."""
    return hits.select(F.concat_ws("  ", F.concat(_place(), F.format_string(":%d:%d", "name_line", "name_col")), "qualified", kind_label(F.col("kind"), F.col("lang_kind"))).alias("value"))


def as_json(rows: DataFrame) -> DataFrame:
    """One object a row; nulls are left out, and encoding unless it isn't UTF-8."""
    names = [c for c in rows.columns if c != "encoding"]
    extra = [F.when(F.col("encoding") != "UTF-8", F.col("encoding")).alias("encoding")] if "encoding" in rows.columns else []
    return rows.select(F.to_json(F.struct(*names, *extra)).alias("value"))
