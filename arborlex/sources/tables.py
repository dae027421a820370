"""Adapters that read the driver's tables as graphs.  They are ours: no other tool knows these tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..functions.extract import Extractor, Registry
from ..functions.languages import default_registry
from ..plans.build import graph_of, prepare, spread
from ..plans.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_rows(df: DataFrame, **columns: Column) -> DataFrame:
    fixed = {"has_errors": F.lit(False), "origin": F.lit("directory"), "fingerprint": F.lit(None).cast("string"), "encoding": F.lit("UTF-8"), "lossy": F.lit(False), "n_bytes": F.lit(None).cast("bigint"), "seq": F.lit(0).cast("bigint")}
    return df.select(*(v.alias(k) for k, v in (fixed | columns).items())).select(*S.FILES.names)


def _self_chain() -> Column:
    return F.array(F.struct(F.col("sidx"), F.col("name"), F.col("kind"), F.col("lang_kind"), F.col("owner"))).cast(S.CHAIN)


def tree(spark: SparkSession, sf_dir: str) -> Graph:
    """region > nation > customer > order > lineitem as org > repo > file > symbol > token.

    Order k spans bytes 100k to 100k + 99; its line n is a token at 100k + 10n whose text is the part's brand.
    """
    t = lambda name: table(spark, sf_dir, name)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("org"), F.col("n_name").alias("repo"))
    path = F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit(".tbl"))
    customers = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "org", "repo", path.alias("path"), F.lower("c_mktsegment").alias("language"))
    files = _file_rows(customers, **{c: F.col(c) for c in ("org", "repo", "path", "language")}, seq=F.col("c_custkey"))
    kind = F.create_map(*(F.lit(x) for x in ("F", "method", "O", "function", "P", "type")))[F.col("o_orderstatus")]
    index = (F.row_number().over(Win.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    start = F.col("o_orderkey") * 100
    numbered = t("orders").select("o_orderkey", "o_custkey", index.alias("sidx"), kind.alias("kind"), F.col("o_orderpriority").alias("lang_kind"))
    syms = numbered.join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumns({
        "name": F.concat(F.lit("Order"), (F.col("o_orderkey") % 1000).cast("string")), "owner": F.lit(None).cast("string"), "start": start, "end": start + 99,
        "start_line": F.col("o_orderkey"), "end_line": F.col("o_orderkey"), "start_col": F.lit(1).cast("bigint"), "end_col": F.lit(100).cast("bigint"),
        "parent_sidx": F.lit(None).cast("int"), "depth": F.lit(0), "first_tok": F.lit(None).cast("int"), "last_tok": F.lit(None).cast("int"), "dir": F.lit("customer"),
    })
    symbols = syms.withColumns({"name_fold": C.ascii_fold(F.col("name")), "qualified": F.col("name"), "chain": _self_chain()})
    cls = F.create_map(*(F.lit(x) for x in ("R", "keyword", "A", "identifier", "N", "literal")))[F.col("l_returnflag")]
    lines = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(syms.select("o_orderkey", "sidx", "org", "repo", "path", "language"), F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10
    order = Win.partitionBy("org", "repo", "path").orderBy("start", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    tokens = lines.withColumns({"start": at.cast("bigint"), "text": F.col("p_brand"), "class": cls, "parent_sidx": F.col("sidx"), "start_line": F.col("l_orderkey"), "end_line": F.col("l_orderkey"), "start_col": F.col("l_linenumber").cast("bigint") * 10 + 1, "end_col": F.col("l_linenumber").cast("bigint") * 10 + 6, "end": at.cast("bigint") + 5})
    tokens = tokens.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
    return Graph(files, symbols.select(*S.SYMBOLS.names), tokens.select(*S.TOKENS.names)).with_derived()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents", with_lines: bool = False) -> Graph:
    """Texts as files of words (no symbols), or with one symbol L<n> per line that holds a word.

    Spans are left out (null): queries that need them build the graph through :func:`plans.build.prepare`.
    """
    raw = table(spark, sf_dir, name)
    if name == "benchmark":
        raw = raw.select(F.col("item_id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("benchmark").alias("source"))
    docs = spread(raw).select(F.col("source").alias("org"), F.col("lang").alias("repo"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("txt").alias("language"), F.coalesce("text", F.lit("")).alias("body"), "doc_id")
    files = _file_rows(docs, **{c: F.col(c) for c in ("org", "repo", "path", "language")}, n_bytes=F.octet_length("body").cast("bigint"), seq=F.col("doc_id"), fingerprint=C.fingerprint(F.col("body").cast("binary"), F.lit("txt"), F.lit(0)))
    spans = {c: F.lit(None).cast("bigint") for c in S.SPAN}
    base = ["org", "repo", "path", "language"]
    if not with_lines:
        words = docs.select(*base, F.posexplode(C.words(F.col("body"))).alias("ordinal", "text"))
        tokens = words.withColumns(spans | {"class": F.lit("identifier"), "parent_sidx": F.lit(None).cast("int")})
        return Graph(files, spark.createDataFrame([], S.SYMBOLS), tokens.select(*S.TOKENS.names)).with_derived()
    lines = docs.select(*base, F.posexplode(F.split("body", "\n", -1)).alias("line", "content"))
    words = lines.select(*base, "line", F.posexplode(C.words(F.col("content"))).alias("nth", "text"))
    # the pair (line, word) orders a file's tokens, so it stands for start and ordinal
    place = F.shiftleft(F.col("line").cast("bigint"), 32)
    tokens = words.withColumns(spans | {"class": F.lit("identifier"), "parent_sidx": F.col("line"), "ordinal": F.col("nth"), "start": place + F.col("nth"), "end": place + F.col("nth") + 1, "start_line": F.col("line").cast("bigint") + 1})
    held = lines.where(F.col("content").rlike(C.WORD))
    symbols = held.withColumns(spans | {"sidx": F.col("line"), "name": F.concat(F.lit("L"), F.col("line").cast("string")), "kind": F.lit("other"), "lang_kind": F.lit("line"), "owner": F.lit(None).cast("string"), "start": place, "end": place + (1 << 32), "start_line": F.col("line").cast("bigint") + 1, "parent_sidx": F.lit(None).cast("int"), "depth": F.lit(0), "first_tok": F.lit(None).cast("int"), "last_tok": F.lit(None).cast("int"), "dir": F.lit("doc")})
    symbols = symbols.withColumns({"name_fold": C.ascii_fold(F.col("name")), "qualified": F.col("name"), "chain": _self_chain()})
    return Graph(files, symbols.select(*S.SYMBOLS.names), tokens.select(*S.TOKENS.names)).with_derived()


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: host > first path segment > path."""
    url = F.regexp_replace("url", r"^[a-z]+://", "")
    path = F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "pages").select(F.coalesce(F.nullif(F.substring_index(url, "/", 1), F.lit("")), F.lit("none")).alias("org"), F.lit("site").alias("repo"), path.alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"), F.lit("directory").alias("origin"))


def pages(spark: SparkSession, sf_dir: str, registry: Registry | None = None) -> Graph:
    return graph_of(prepare(page_files(spark, sf_dir), registry or default_registry()))


def conversations(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns as small files; the role is the language."""
    raw = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("org"), F.col("conv_id").cast("string").alias("repo"), F.concat(F.lit("turn/"), F.col("turn").cast("string")).alias("path"), F.lower("role").alias("language"), F.coalesce("text", F.lit("")).alias("body"))
    spans = {c: F.lit(None).cast("bigint") for c in S.SPAN}
    files = _file_rows(raw, **{c: F.col(c) for c in ("org", "repo", "path", "language")})
    words = raw.select("org", "repo", "path", "language", F.posexplode(C.words(F.col("body"))).alias("ordinal", "text"))
    return Graph(files, spark.createDataFrame([], S.SYMBOLS), words.withColumns(spans | {"class": F.lit("identifier"), "parent_sidx": F.lit(None).cast("int")}).select(*S.TOKENS.names)).with_derived()


def line_registry() -> Registry:
    """A registry with the one-symbol-per-line plug-in for plain text."""
    from ..functions.languages import lines

    out = default_registry()
    out.register(Extractor("txt", lines, 1, ("txt",)))
    return out
