"""Queries that run the store, the tools, the tree and the decoders over stored graphs; SQL states the answers.

Those that only read share one store per session and folder of tables; those that change one make their own.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.languages import default_registry
from .operators import catalog as K
from .operators import render
from .operators import tree as TR
from .operators.scope import PermissionDenied, Principal, Rules, Scope, decide, lint, parse_policies, scoped
from .operators.search import Query, SymbolQuery, search, search_symbols
from .plans import graph as G
from .plans.build import prepare, spread
from .plans.tools import BadArgument, Page, Tools
from .sample_queries import _tokens_sql, _values
from .samples import SAMPLES
from .sources import tables as TB
from .sources import walk
from .sources.store import Store, scratch
from .streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_BUILT: dict[tuple, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


# -- documents as files ---------------------------------------------------------------------------

#: The default dialect as one RE2 pattern, and the class of what it finds.
_TOKEN = r"""//[^\n]*|(?s:/\*.*?(?:\*/|\z))|[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{N}_]*|[0-9](?:[\p{L}\p{N}_.]*[\p{L}\p{N}_])?|(?s:"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\z))|(?s:`[^`\\]*(?:\\.[^`\\]*)*(?:`|\\?\z))|''(?:\\[^''\n]{1,9}|[^''\\\n])''|[^\s\p{Z}\x0B\x{85}\x{FEFF}]"""
_CLASS = r"""CASE WHEN starts_with(x, '//') OR starts_with(x, '/*') THEN 'comment' WHEN regexp_matches(x, '^[\p{L}\p{Nl}_]') THEN 'identifier' WHEN length(x)>1 OR regexp_matches(x, '^[0-9"`]') THEN 'literal' WHEN contains('+-*/%=<>!&|^~?@', x) THEN 'operator' ELSE 'punctuation' END"""
_DOCS = """docs AS (SELECT coalesce(nullif(source,''),'none') AS org, coalesce(nullif(lang,''),'none') AS repo, 'doc/'||doc_id||'.txt' AS path, doc_id, coalesce(text,'') AS t FROM documents)"""
_TOKS = f"{_DOCS}, tok AS (SELECT org, repo, path, doc_id, unnest(x) AS x, generate_subscripts(x,1)-1 AS n FROM (SELECT *, regexp_extract_all(t, '{_TOKEN}') AS x FROM docs))"
_PER_REPO = "per AS (SELECT docs.org, docs.repo, count(*) AS files FROM docs GROUP BY ALL), pert AS (SELECT org, repo, count(*) AS tokens FROM tok GROUP BY ALL)"
_FIRST = "(SELECT min(org) FROM docs)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    raw = spread(TB.table(spark, sf, "documents"))
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none"))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return raw.select(name("source").alias("org"), name("lang").alias("repo"), path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.lit("directory").alias("origin"))


def new_store(spark: SparkSession, sf: str) -> Store:
    s = Store(spark, scratch(spark, "store"))
    s.upsert(files(spark, sf))
    return s


def stored(spark: SparkSession, sf: str, make: Callable[[SparkSession, str], Store] = new_store) -> Store:
    """The shared store of this session and folder; nothing that reads it changes it."""
    key = (spark.sparkContext.applicationId, sf, make.__name__)
    if key in _BUILT and Store(spark, _BUILT[key]).detect_format() is not None:
        return Store(spark, _BUILT[key])
    s = make(spark, sf)
    _BUILT[key] = s.root
    return s


def first_org(s: Store) -> str:
    return s.graph().files.agg(F.min("org")).first()[0]


@query(f"WITH {_TOKS} SELECT doc_id, {_CLASS} AS class, count(*) AS count FROM tok GROUP BY ALL")
def tokenize_default(spark, sf):
    """The default dialect with built-in functions: classes of all tokens of all documents."""
    p = spread(TB.table(spark, sf, "documents")).select("doc_id", F.explode(C.pieces(F.coalesce("text", F.lit("")))).alias("p"))
    return p.select("doc_id", C.piece_class(F.col("p")).alias("class")).where("class is not null").groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("count"))


@query(f"WITH {_TOKS}, u AS (SELECT org, path, count(*) AS n, count(DISTINCT x) AS m FROM tok GROUP BY ALL) SELECT docs.org, 'ok' AS status, count(*) AS files, CAST(coalesce(sum(n),0) AS BIGINT) AS tokens, CAST(coalesce(sum(m),0) AS BIGINT) AS terms FROM docs LEFT JOIN u ON docs.path=u.path AND docs.org=u.org GROUP BY docs.org")
def ingest_documents(spark, sf):
    """Decode, detect, fingerprint, lex, extract and arrange every document: files, tokens and terms by organisation."""
    done = prepare(files(spark, sf))
    return done.groupBy("org", "status").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size("postings")).alias("terms"))


@query(f"WITH {_TOKS}, u AS (SELECT path, count(*) AS n FROM tok GROUP BY ALL) SELECT org, 'ok' AS status, false AS replaced, count(*) AS files, CAST(coalesce(sum(n),0) AS BIGINT) AS tokens FROM docs LEFT JOIN u USING (path) GROUP BY org")
def store_upsert(spark, sf):
    s = Store(spark, scratch(spark, "store"))
    return s.upsert(files(spark, sf)).groupBy("org", "status", "replaced").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))


@query(f"WITH {_DOCS} SELECT org, CASE WHEN doc_id%3=0 THEN 'ok' ELSE 'unchanged' END AS status, doc_id%3=0 AS replaced, count(*) AS files FROM docs GROUP BY ALL UNION ALL SELECT org, 'superseded', false, count(*) FROM docs WHERE doc_id%2=0 GROUP BY org UNION ALL SELECT 'new', 'ok', false, 1")
def store_upsert_again(spark, sf):
    """Changed files are replaced, unchanged ones aren't parsed, of repeated paths the last wins, new ones are added."""
    s = new_store(spark, sf)
    number = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    rows = files(spark, sf).withColumn("seq", F.lit(2).cast("bigint")).withColumn("content", F.when(number % 3 == 0, F.concat(F.col("content"), F.lit(" more").cast("binary"))).otherwise(F.col("content")))
    older = files(spark, sf).where(number % 2 == 0).withColumn("seq", F.lit(1).cast("bigint")).withColumn("path", F.concat(F.lit("./x/../"), "path")).withColumn("content", F.lit("old").cast("binary"))
    new = spark.createDataFrame([("new", "r", "a.txt", bytearray(b"x"), "directory", 1)], "org string, repo string, path string, content binary, origin string, seq long")
    return s.upsert(rows.unionByName(older).unionByName(new)).groupBy("org", "status", "replaced").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {_TOKS} SELECT org, repo, path, CAST(count(*) AS BIGINT) AS count FROM tok WHERE x='the' AND org={_FIRST} GROUP BY ALL")
def store_search(spark, sf):
    """A roll-up from the stored postings of one organisation: other partitions are not read."""
    s = stored(spark, sf)
    return search(s.graph(), Query("the", "file", org=first_org(s))).select("org", "repo", F.col("file").alias("path"), "count")


@query(f"WITH {_TOKS}, {_PER_REPO} SELECT per.org, per.repo, 'txt' AS language, files, CAST(0 AS BIGINT) AS symbols, coalesce(tokens,0) AS tokens FROM per LEFT JOIN pert USING (org, repo)")
def store_describe(spark, sf):
    return K.describe(stored(spark, sf).graph())


@query(f"WITH {_TOKS} SELECT org, repo, {_CLASS} AS label, CAST(count(*) AS BIGINT) AS count FROM tok GROUP BY ALL")
def store_token_classes(spark, sf):
    return K.labels(stored(spark, sf).graph(), "token_class")


@query(f"WITH {_TOKS}, {_PER_REPO} SELECT CASE WHEN per.org={_FIRST} THEN 'deleted' ELSE 'left' END AS what, per.org, per.repo, files, coalesce(tokens,0) AS tokens FROM per LEFT JOIN pert USING (org, repo)")
def store_delete(spark, sf):
    """The totals that a deletion reports, and what is described afterwards."""
    s = new_store(spark, sf)
    gone = s.delete(first_org(s)).select(F.lit("deleted").alias("what"), "org", "repo", "files", "tokens")
    return gone.unionByName(K.describe(s.graph()).select(F.lit("left").alias("what"), "org", "repo", "files", "tokens"))


_PRUNED = f"org={_FIRST} AND repo=(SELECT min(repo) FROM docs WHERE org={_FIRST}) AND doc_id%4<>0"


@query(f"WITH {_DOCS} SELECT 'pruned' AS what, org, path FROM docs WHERE {_PRUNED} UNION ALL SELECT 'left', org, path FROM docs WHERE NOT ({_PRUNED})")
def store_prune(spark, sf):
    """Files that are gone from their directory are removed; a dry run before it removes nothing."""
    s = new_store(spark, sf)
    org = first_org(s)
    here = s.graph().files.where(F.col("org") == org)
    repo = here.agg(F.min("repo")).first()[0]
    keep = here.where((F.col("repo") == repo) & (F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 4 == 0)).select("path")
    dry, pruned = s.prune(org, repo, keep, dry_run=True), s.prune(org, repo, keep)
    if dry.count() != pruned.count():
        raise AssertionError("a dry run names what a run removes")
    return pruned.select(F.lit("pruned").alias("what"), "org", "path").unionByName(s.graph().files.select(F.lit("left").alias("what"), "org", "path"))


@query(f"WITH {_TOKS}, live AS (SELECT DISTINCT x FROM tok WHERE org<>{_FIRST}) SELECT (SELECT count(DISTINCT x) FROM tok WHERE x NOT IN (SELECT x FROM live)) AS dead, CAST(0 AS BIGINT) AS dead_after, CAST(1 AS BIGINT) AS segments, (SELECT count(*) FROM docs WHERE org<>{_FIRST}) AS files")
def store_vacuum(spark, sf):
    """Vacuum counts the terms that no live token has, and leaves one segment and no dead term."""
    s = new_store(spark, sf)
    s.delete(first_org(s))
    dead = s.vacuum(grace=0)
    after = s.dead_terms().agg(F.count(F.lit(1)).alias("dead_after"))
    return after.crossJoin(s.space().agg(F.count(F.lit(1)).alias("segments"))).crossJoin(s.graph().files.agg(F.count(F.lit(1)).alias("files"))).select(F.lit(dead).cast("bigint").alias("dead"), "dead_after", "segments", "files")


@query(f"WITH {_TOKS} SELECT 'org' AS kind, count(DISTINCT org) AS count FROM docs UNION ALL SELECT 'repo', count(DISTINCT org||'/'||repo) FROM docs UNION ALL SELECT 'file', count(*) FROM docs UNION ALL SELECT 'token', count(*) FROM tok")
def store_export(spark, sf):
    out = scratch(spark, "export")
    stored(spark, sf).export(out, compression="gzip")
    return spark.read.json(out, schema="key string, parent string, kind string, name string").groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


@query(f"WITH {_DOCS}, n AS (SELECT org, count(*) AS files FROM docs GROUP BY org) SELECT 'snapshot' AS what, org, files FROM n UNION ALL SELECT 'copy', org, files FROM n WHERE org<>{_FIRST} UNION ALL SELECT 'installed', org, files FROM n WHERE org<>{_FIRST}")
def store_snapshots(spark, sf):
    """A pinned snapshot keeps what was there; a copy and a store that installs it have what is there now."""
    s = new_store(spark, sf)
    pinned = s.snapshot()
    s.delete(first_org(s))
    copy = s.export_snapshot(scratch(spark, "copy"))
    other = Store(spark, scratch(spark, "other"))
    other.upsert(spark.createDataFrame([("old", "r", "a.txt", bytearray(b"x"))], "org string, repo string, path string, content binary"))
    other.install_snapshot(copy.root)
    count = lambda x, what: x.graph().files.groupBy("org").agg(F.count(F.lit(1)).alias("files")).select(F.lit(what).alias("what"), "org", "files")
    return count(pinned, "snapshot").unionByName(count(copy, "copy")).unionByName(count(other, "installed"))


@query(f"WITH {_TOKS}, p AS (SELECT x, path, count(*) AS n FROM tok GROUP BY ALL) SELECT count(*) AS postings, CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS inconsistent FROM p")
def store_consistency(spark, sf):
    """Stored postings against the base tables."""
    s = stored(spark, sf)
    bad = s.inconsistent().agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("inconsistent"))
    return s.graph().postings.agg(F.count(F.lit(1)).alias("postings"), F.sum("count").alias("tokens")).crossJoin(bad)


@query(f"WITH {_TOKS} SELECT n AS ordinal, x AS text, {_CLASS} AS class FROM tok WHERE org={_FIRST} AND path=(SELECT min(path) FROM docs WHERE org={_FIRST}) AND n BETWEEN 3 AND 40")
def store_token_range(spark, sf):
    s = stored(spark, sf)
    at = s.graph().files.where(F.col("org") == first_org(s)).agg(F.min_by(F.struct(*G.FILE_KEY), "path").alias("k")).first()["k"]
    return s.file_tokens(at["org"], at["repo"], at["path"], 3, 40).select(F.col("ordinal").cast("bigint").alias("ordinal"), "text", "class")


@query("WITH b AS (SELECT item_id, coalesce(text,'') AS t FROM benchmark) SELECT count(*) AS files, CAST(0 AS BIGINT) AS replayed, CAST(1 AS BIGINT) AS batches FROM b")
def store_stream(spark, sf):
    """A file stream into a store, exactly once: replaying its batch does nothing."""
    s = Store(spark, scratch(spark, "stream"))
    path = f"{sf}/benchmark.parquet"
    fs, at = s._fs(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    raw = reader.parquet(path) if fs.getFileStatus(at).isDirectory() else reader.option("pathGlobFilter", "benchmark.parquet").parquet(sf)
    rows = raw.select(F.lit("stream").alias("org"), F.lit("r").alias("repo"), F.concat(F.lit("item/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    ingest(rows, s, "items", scratch(spark, "stream-progress")).awaitTermination()
    batches = len(s.manifest().stream_batches)
    again = s.upsert(spark.createDataFrame([("stream", "r", "late.txt", bytearray(b"x"))], "org string, repo string, path string, content binary"), stream=("items", 0))
    return s.graph().files.agg(F.count(F.lit(1)).alias("files")).crossJoin(again.agg(F.count(F.lit(1)).alias("replayed"))).withColumn("batches", F.lit(batches).cast("bigint"))


# -- sample sources as one store ------------------------------------------------------------------


def sample_store(spark: SparkSession, sf: str) -> Store:
    """Every sample source for every nation: organisation ``samples``, a repository for each language."""
    nations = TB.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    kinds = spark.createDataFrame([(x, s.extension, s.source()) for x, s in SAMPLES.items()], "repo string, extension string, source string")
    rows = nations.crossJoin(F.broadcast(kinds)).select(F.lit("samples").alias("org"), "repo", F.concat(F.lit("f"), "k", F.lit("."), "extension").alias("path"), F.replace("source", F.lit("{k}"), "k").cast("binary").alias("content"), F.lit("directory").alias("origin"))
    s = Store(spark, scratch(spark, "samples"))
    s.upsert(rows)
    return s


def samples(spark: SparkSession, sf: str) -> Tools:
    return Tools(stored(spark, sf, sample_store))


def _page(spark: SparkSession, page: Page, columns: str, has_more: bool = False) -> DataFrame:
    names = [c.split()[0].strip("`") for c in columns.split(", ")]
    rows = [tuple(r[n] for n in names) + ((page.has_more,) if has_more else ()) for r in page.rows]
    return spark.createDataFrame(rows, columns + (", has_more boolean" if has_more else ""))


_COUNTS = _values([(x, len(s.symbols()), len(s.tokens()) - 1) for x, s in SAMPLES.items()])
_EVERY = f"""d(repo, ext, i, name, kind, lang_kind, owner, a, b) AS (VALUES {_values([(x, s.extension, i, *y) for x, s in SAMPLES.items() for i, y in enumerate(s.symbols())])}),
 s AS (SELECT n_nationkey AS k, repo, 'f'||n_nationkey||'.'||ext AS path, replace(name, '{{k}}', CAST(n_nationkey AS VARCHAR)) AS name, kind, lang_kind, i, a, b FROM d, nation)"""
_JAVA = f"""{_tokens_sql(SAMPLES["java"])}, d(i, name, kind, lang_kind, owner, a, b) AS (VALUES {_values([(i, *y) for i, y in enumerate(SAMPLES["java"].symbols())])}),
 s AS (SELECT p.k, i, replace(name, '{{k}}', CAST(p.k AS VARCHAR)) AS name, kind, lang_kind, a, b, p.start, q.stop, p.start_line, p.start_col, q.end_line, q.end_col FROM d JOIN t p ON p.n=a JOIN t q ON q.n=b AND q.k=p.k)"""


@query(f"WITH c(repo, symbols, tokens) AS (VALUES {_COUNTS}) SELECT 'samples' AS org, repo, (SELECT count(*) FROM nation) AS files, symbols*(SELECT count(*) FROM nation) AS symbols, tokens*(SELECT count(*) FROM nation) AS tokens FROM c")
def tool_describe(spark, sf):
    rows = [(r["org"], r["repo"], r["files"], sum(x["symbols"] for x in r["languages"].values()), sum(x["tokens"] for x in r["languages"].values())) for r in samples(spark, sf).describe()]
    return spark.createDataFrame(rows, "org string, repo string, files long, symbols long, tokens long")


@query(f"WITH c(repo, symbols, tokens) AS (VALUES {_COUNTS}) SELECT 'samples' AS org, repo, true AS has_more FROM c ORDER BY repo LIMIT 10 OFFSET 5")
def tool_list_repos(spark, sf):
    return _page(spark, samples(spark, sf).list_repos("samples", limit=10, offset=5), "org string, repo string", True)


@query("SELECT 'f'||n_nationkey||'.java' AS path, false AS has_more FROM nation WHERE n_nationkey=1 OR n_nationkey BETWEEN 10 AND 19 ORDER BY path LIMIT 50 OFFSET 2")
def tool_list_files(spark, sf):
    return _page(spark, samples(spark, sf).list_files("samples", "java", "f1", offset=2), "path string", True)


@query(f"WITH {_EVERY} SELECT repo, path AS file, name, kind, lang_kind FROM s WHERE ends_with(name,'17') ORDER BY repo, path, i LIMIT 500")
def tool_find_symbols(spark, sf):
    return _page(spark, samples(spark, sf).find_symbols("*17", limit=500), "repo string, file string, name string, kind string, lang_kind string")


@query(f"WITH {_EVERY} SELECT repo, path AS file, name, lang_kind FROM s WHERE kind='constant' AND repo='rust' AND (starts_with(name,'B') OR starts_with(name,'b')) ORDER BY path, i")
def tool_find_symbols_filtered(spark, sf):
    return _page(spark, samples(spark, sf).find_symbols("b*", limit=500, kind="Constant", language="RUST"), "repo string, file string, name string, lang_kind string")


@query(f'WITH {_JAVA} SELECT name, kind, lang_kind, start, stop AS "end" FROM s WHERE k=3')
def tool_file_outline(spark, sf):
    return _page(spark, samples(spark, sf).file_outline("samples", "java", "./f3.java"), "name string, kind string, lang_kind string, start long, end long")


@query(f"WITH {_JAVA} SELECT text, class, start_line, start_col FROM t WHERE k=3 AND start_line BETWEEN 2 AND 3")
def tool_file_tokens(spark, sf):
    return _page(spark, samples(spark, sf).file_tokens("samples", "java", "f3.java", 2, 3), "text string, class string, start_line long, start_col long")


def _innermost(accept: str) -> str:
    """Each token ``x`` of the Java files with the innermost symbol around it that is accepted; files without any stay."""
    return f"""h AS (SELECT t.k, t.n, arg_max(s.i, s.a*1000-s.b) FILTER (WHERE s.i IS NOT NULL) AS i FROM t LEFT JOIN s ON s.k=t.k AND s.a<=t.n AND t.n<=s.b AND {accept} WHERE t.text='int' GROUP BY t.k, t.n)
 SELECT 'f'||h.k||'.java' AS file, any_value(s.name) AS name, any_value(s.kind) AS symbol_kind, CAST(count(*) AS BIGINT) AS count, h.i IS NULL AS no_matching_symbol FROM h LEFT JOIN s ON s.k=h.k AND s.i=h.i GROUP BY h.k, h.i"""


def _grain(spark: SparkSession, sf: str, grain: str) -> DataFrame:
    hits = search(samples(spark, sf).graph, Query("int", grain, repo="java"))
    return hits.select("file", F.element_at(F.split("symbol", "::"), -1).alias("name"), "symbol_kind", "count", "no_matching_symbol")


@query(f"WITH {_JAVA}, {_innermost('true')}")
def nested_search_symbol(spark, sf):
    """The innermost symbol of any kind, several levels deep."""
    return _grain(spark, sf, "symbol")


@query(f"WITH {_JAVA}, {_innermost(chr(40) + 's.kind IN ' + chr(40) + repr('method') + ',' + repr('function') + '))')}")
def nested_search_method(spark, sf):
    return _grain(spark, sf, "method")


@query(f"WITH {_JAVA}, {_innermost('s.kind=' + repr('type'))}")
def nested_search_class(spark, sf):
    return _grain(spark, sf, "class")


@query(f"WITH {_JAVA}, x AS (SELECT 'symbol' AS kind, name, start, stop, 0 AS tok, i AS o FROM s WHERE k=3 UNION ALL SELECT 'token', text, start, stop, 1, n FROM t WHERE k=3) SELECT kind, name, start, true AS has_more FROM x ORDER BY start, tok, stop DESC, o LIMIT 30 OFFSET 4")
def tree_nested_page(spark, sf):
    """A page of a file's nodes in depth-first order, and whether there are more."""
    rows, more = TR.page_with_more(TR.descendants(G.nodes(samples(spark, sf).graph), "file/samples/java/f3.java").select("kind", "name", "start"), 30, 4)
    return spark.createDataFrame([(*r, more) for r in rows], "kind string, name string, start long, has_more boolean")


_M = "(SELECT i FROM s WHERE k=3 AND name='m3')"


@query(f"WITH {_JAVA}, m AS (SELECT a.* FROM s m JOIN s a ON a.k=m.k AND a.a<=m.a AND a.b>=m.b WHERE m.k=3 AND m.name='m3') SELECT 'symbol' AS kind, name FROM m UNION ALL VALUES ('file','f3.java'),('repo','java'),('org','samples')")
def tree_nested_ancestors(spark, sf):
    """The chain above a token inside a method, several levels deep."""
    g = samples(spark, sf).graph
    at = g.symbols.where("repo = 'java' and path = 'f3.java' and name = 'm3'").select("first_tok").first()[0]
    return TR.ancestors(g, "token", "samples", "java", "f3.java", at + 5).select("kind", "name")


@query(f"WITH {_JAVA} SELECT p.name AS child, q.name AS parent FROM s p JOIN s q ON q.k=p.k AND q.a<=p.a AND q.b>=p.b AND q.i<>p.i WHERE p.k=3 AND NOT EXISTS (SELECT 1 FROM s r WHERE r.k=3 AND r.i NOT IN (p.i,q.i) AND r.a<=p.a AND r.b>=p.b AND r.a>=q.a AND r.b<=q.b)")
def tree_nested_parents(spark, sf):
    nodes = G.nodes(samples(spark, sf).graph).where("path = 'f3.java' and kind = 'symbol'")
    up = nodes.select(F.col("key").alias("parent"), F.col("name").alias("up"))
    return nodes.join(up, "parent").select(F.col("name").alias("child"), F.col("up").alias("parent"))


@query(f"WITH {_JAVA} SELECT n AS ordinal, text FROM t JOIN s ON s.k=t.k AND n BETWEEN a AND b WHERE t.k=3 AND name='m3'")
def tree_symbol_token_range(spark, sf):
    g = samples(spark, sf).graph
    at = g.symbols.where("repo = 'java' and path = 'f3.java' and name = 'm3'").select("sidx").first()[0]
    return TR.tokens_of(g, "samples", "java", "f3.java", at).select(F.col("ordinal").cast("int").alias("ordinal"), "text")


@query(f"WITH {_JAVA}, i AS (SELECT t.k, n, max_by(s.name, s.a*1000-s.b) AS name FROM t LEFT JOIN s ON s.k=t.k AND s.a<=t.n AND t.n<=s.b GROUP BY t.k, n) SELECT 'f'||k||'.java' AS path, n AS ordinal, name FROM i")
def containment_nested(spark, sf):
    """The innermost symbol of every token, by levels."""
    g = samples(spark, sf).graph.only(F.col("repo") == "java")
    found = G.containment(g.symbols, g.tokens.select(*G.FILE_KEY, "ordinal", "start"), G.FILE_KEY, "ordinal")
    names = g.symbols.select(*G.FILE_KEY, F.col("sidx").alias("parent_sidx"), "name")
    return found.join(names, [*G.FILE_KEY, "parent_sidx"], "left").select("path", F.col("ordinal").cast("int").alias("ordinal"), "name")


@query(f"""WITH {_JAVA}, p AS (SELECT s.k, s.i, min_by(t.start_line||':'||t.start_col, t.n) FILTER (WHERE t.text=s.name) AS pos FROM s JOIN t ON t.k=s.k AND t.n BETWEEN s.a AND s.b AND t.class='identifier' GROUP BY s.k, s.i)
 SELECT 'samples/java/f'||s.k||'.java:'||pos||'  '||s.name||'  '||CASE WHEN kind=lang_kind THEN kind ELSE kind||'/'||lang_kind END AS value FROM s JOIN p USING (k, i) WHERE starts_with(s.name,'C') AND s.kind='type'""")
def render_symbols(spark, sf):
    hits = search_symbols(samples(spark, sf).graph, SymbolQuery("C*", kind="type", repo="java"))
    return render.symbols_as_text(hits.withColumn("qualified", F.element_at(F.split("qualified", "::"), -1)))


@query(f"WITH {_JAVA} SELECT 'samples/java/f'||k||'.java  x'||count(*) AS text, '{{\"org\":\"samples\",\"repo\":\"java\",\"file\":\"f'||k||'.java\",\"count\":'||count(*)||'}}' AS json FROM t WHERE text='int' GROUP BY k")
def render_hits(spark, sf):
    """Roll-ups as text lines and as JSON lines; null fields are left out."""
    hits = search(samples(spark, sf).graph, Query("int", "file", repo="java"))
    text = render.hits_as_text(hits).select(F.regexp_extract("value", r"f(\d+)", 1).alias("k"), F.col("value").alias("text"))
    json = render.as_json(hits.select("org", "repo", "file", "count")).select(F.regexp_extract("value", r"f(\d+)", 1).alias("k"), F.col("value").alias("json"))
    return text.join(json, "k").select("text", "json")


@query("VALUES ('empty_text'), ('invalid_limit'), ('invalid_offset'), ('invalid_pattern'), ('invalid_query'), ('invalid_range'), ('unknown_filter')")
def _error_codes(spark, sf):
    t = samples(spark, sf)
    calls = (lambda: t.search(""), lambda: t.list_repos(limit=0), lambda: t.list_repos(offset=-1), lambda: t.find_symbols("*a*b*"), lambda: t.search("x", "nonsense"), lambda: t.file_tokens("samples", "java", "f3.java", 3, 2), lambda: t.find_symbols("*", language="jaba"))
    codes = []
    for call in calls:
        try:
            call()
        except BadArgument as e:
            codes.append((e.code,))
    return spark.createDataFrame(codes, "col0 string")


QUERIES["tool_error_codes"], SQL["tool_error_codes"] = QUERIES.pop("_error_codes"), SQL.pop("_error_codes")


# -- decoding --------------------------------------------------------------------------------------

_ODD = "é " * 4
_TEXTS = (
    # name, label, strict, bytes of the text as a column of the nation's name, expected status and encoding
    ("utf8", None, False, lambda t: F.encode(t, "UTF-8"), "ok", "UTF-8"),
    ("utf8-mark", None, False, lambda t: F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8")), "ok", "UTF-8"),
    ("utf16le-mark", None, False, lambda t: F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE")), "ok", "UTF-16LE"),
    ("utf16be-mark", None, False, lambda t: F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE")), "ok", "UTF-16BE"),
    ("utf16le", None, False, lambda t: F.encode(t, "UTF-16LE"), "ok", "UTF-16LE"),
    ("utf16be", None, False, lambda t: F.encode(t, "UTF-16BE"), "ok", "UTF-16BE"),
    ("latin-hint", "latin1", False, lambda t: F.encode(t, "ISO-8859-1"), "ok", "windows-1252"),
    ("latin", None, False, lambda t: F.encode(t, "ISO-8859-1"), "ok", "windows-1252"),
    ("latin-strict", None, True, lambda t: F.encode(t, "ISO-8859-1"), "not UTF-8", "windows-1252"),
    ("jis", None, False, lambda t: F.concat(F.unhex(F.lit("1B2442467C1B2842")), F.encode(F.replace(t, F.lit("é"), F.lit("e")), "UTF-8")), "ok", "ISO-2022-JP"),
    ("binary", None, False, lambda t: F.concat(F.encode(t, "UTF-8"), F.unhex(F.lit("0001"))), "binary", None),
    ("no-label", "no-such", False, lambda t: F.encode(t, "UTF-8"), "unknown encoding", None),
)
_WANTED = _values([(name, status, encoding, "日" if name == "jis" else "", "e" if name == "jis" else "é") for name, _, _, _, status, encoding in _TEXTS])


@query(f"""WITH w(name, status, encoding, lead, e) AS (VALUES {_WANTED}), x AS (SELECT n_nationkey AS k, w.*, lead||upper(e)||'x'||replace(n_name,' ','_') AS word FROM w, nation)
 SELECT CAST(k AS INTEGER) AS k, name, status, CASE WHEN status IN ('ok') THEN encoding END AS encoding, CASE WHEN status='ok' THEN lead||replace(e,'é','é')||'x'||n_name_ END AS first_token FROM (SELECT x.*, replace(n_name,' ','_') AS n_name_ FROM x JOIN nation ON k=n_nationkey)""")
def decode_files(spark, sf):
    """Marks, hints, UTF-16 without marks, code pages, binary files and refusals: status, encoding and the first token."""
    text = F.concat(F.lit("éx"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" and some more plain words"))
    out = None
    for name, label, strict, make, _, _ in _TEXTS:
        part = TB.table(spark, sf, "nation").select(F.lit("o").alias("org"), F.lit(name).alias("repo"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"), make(text).alias("content"), F.lit(label).cast("string").alias("encoding"), F.lit(strict).alias("strict"))
        out = part if out is None else out.unionByName(part)
    done = prepare(out)
    ok = F.col("status") == "ok"
    return done.select(F.regexp_extract("path", r"f(\d+)", 1).cast("int").alias("k"), F.col("repo").alias("name"), "status", F.when(ok, F.col("encoding")).alias("encoding"), F.when(ok, F.col("tokens")[0]["text"]).alias("first_token"))


# -- directories, policies, damaged trees -----------------------------------------------------------

_WALK = (("a.py", "def f():\n    return foo\n", None), ("b.log", "x", "ignored"), ("keep.log", "y z", None), ("sub/c.go", "package p\n", None), ("sub/deep/_d.txt", "one two", None), ("build/y.py", "x = 1", "ignored"), (".git/x", "no", "ignored"), (".gitignore", "*.log\n!keep.log\n/build/\n", None), (".arborlex.toml", '[encoding]\n"old/*.txt" = "latin1"\n', None), ("old/e.txt", "caf\u00e9", None))


def _folder(spark: SparkSession) -> str:
    """A small directory tree in the shared folder."""
    root = scratch(spark, "walk").removeprefix("file://").removeprefix("file:")
    for path, text, _ in _WALK:
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(text.encode("latin-1"))
    os.symlink(os.path.join(root, "a.py"), os.path.join(root, "link.py"))
    return root


@query("VALUES ('ok', 7), ('skipped: symlink', 1)".replace("VALUES", "SELECT * FROM (VALUES") + ") t(status, files)")
def walk_directory(spark, sf):
    """Ignore files, hidden names, links and the encoding table of a directory, indexed by the tool."""
    rows = Tools(Store(spark, scratch(spark, "walked"))).index_path(_folder(spark), "o", "r")
    return spark.createDataFrame([(r["status"], r["files"]) for r in rows], "status string, files int")


@query("SELECT * FROM (VALUES ('a.py', 'python', 'UTF-8', 7), ('keep.log', 'log', 'UTF-8', 2), ('sub/c.go', 'go', 'UTF-8', 2), ('sub/deep/_d.txt', 'txt', 'UTF-8', 2), ('.gitignore', 'unknown', 'UTF-8', 10), ('.arborlex.toml', 'toml', 'UTF-8', 6), ('old/e.txt', 'txt', 'windows-1252', 1)) t(path, language, encoding, tokens)")
def walk_files(spark, sf):
    files, _ = walk.directory(spark, _folder(spark), "o", "r")
    return prepare(files).select("path", "language", "encoding", F.size("tokens").alias("tokens"))


@query("SELECT * FROM (VALUES ('f1.txt', 'ok', 'file', 3)) t(path, status, origin, tokens)")
def walk_single_file(spark, sf):
    root = _folder(spark)
    with open(os.path.join(root, "f1.txt"), "w") as f:
        f.write("one two three")
    return prepare(walk.single_file(spark, "file://" + os.path.join(root, "f1.txt"), "o", "r")).select("path", "status", "origin", F.size("tokens").alias("tokens"))


@query("SELECT * FROM (VALUES ('sub/c.go', 'pruned'), ('a.py', 'left'), ('keep.log', 'left'), ('sub/deep/_d.txt', 'left'), ('.gitignore', 'left'), ('.arborlex.toml', 'left'), ('old/e.txt', 'left')) t(path, what)")
def walk_prune(spark, sf):
    root, tools = _folder(spark), Tools(Store(spark, scratch(spark, "walked")))
    tools.index_path(root, "o", "r")
    os.unlink(os.path.join(root, "sub/c.go"))
    gone = [(p, "pruned") for p in tools.prune(root, "o", "r")]
    return spark.createDataFrame(gone, "path string, what string").unionByName(tools.store.graph().files.select("path", F.lit("left").alias("what")))


@query("SELECT r_name AS org, r_name IN ('ASIA','EUROPE') AS read, r_name='ASIA' AS \"index\" FROM region")
def policy_decisions(spark, sf):
    text = """permit(principal in Group::"readers", action in [Action::"read"], resource in Org::"ASIA"); permit(principal, action == Action::"read", resource in Org::"EUROPE");
     permit(principal == Token::"ci", action, resource in Org::"ASIA"); forbid(principal, action == Action::"index", resource in Org::"EUROPE");"""
    policies, who = parse_policies(text), Principal("ci", frozenset({"readers"}))
    names = [r[0] for r in TB.table(spark, sf, "region").select("r_name").collect()]
    return spark.createDataFrame([(n, decide(policies, who, "read", "Org", n), decide(policies, who, "index", "Org", n)) for n in names], "org string, read boolean, index boolean")


@query("SELECT * FROM (VALUES ('a: the id is used twice'), ('a: names no action'), ('#2: a Repo is named org/repo'), ('#3: unknown resource type Team')) t(note)")
def policy_lint(spark, sf):
    text = """@id("a") permit(principal, action, resource); @id("a") permit(principal, action in [], resource);
     permit(principal, action, resource == Repo::"web"); forbid(principal, action, resource in Team::"x");"""
    return spark.createDataFrame([(note,) for note in lint(parse_policies(text))], "note string")


@query("SELECT r_name AS org, r_name<>'EUROPE' AS refused, (SELECT count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=r_regionkey AND r_name='EUROPE' AND n_name<>'FRANCE') AS files FROM region")
def scope_refusals(spark, sf):
    """What an intersection of scopes refuses by name, and what it lets be seen."""
    g = TB.tree(spark, sf)
    scope = Scope((Rules(orgs=frozenset({"ASIA", "EUROPE"})),)).intersect(Scope((Rules(any=True, deny_orgs=frozenset({"ASIA"}), deny_repos=frozenset({("EUROPE", "FRANCE")})),)))
    seen = {r["org"]: r["files"] for r in scoped(g, scope).files.groupBy("org").agg(F.count(F.lit(1)).alias("files")).collect()}
    rows = []
    for (org,) in TB.table(spark, sf, "region").select("r_name").collect():
        try:
            scope.check_named(g, "search", org, None)
            rows.append((org, False, seen.get(org, 0)))
        except PermissionDenied:
            rows.append((org, True, seen.get(org, 0)))
    return spark.createDataFrame(rows, "org string, refused boolean, files long")


@query(f"WITH c(repo, symbols, tokens) AS (VALUES {_COUNTS}) SELECT repo AS language, (SELECT count(*) FROM nation) AS files, symbols*(SELECT count(*) FROM nation) AS symbols, true AS refused FROM c WHERE repo IN ('go','java')")
def store_extractor_gaps(spark, sf):
    """Stored symbols of languages whose extractors are gone: listed, and a reason to refuse."""
    registry = default_registry()
    for language in ("go", "java"):
        registry.by_language.pop(language)
    s = Store(spark, stored(spark, sf, sample_store).root, registry)
    try:
        s.check_gaps()
        refused = False
    except RuntimeError:
        refused = True
    s.check_gaps(force=True)
    return s.extractor_gaps().select("language", "files", "symbols", F.lit(refused).alias("refused"))


@query("SELECT count(*) AS bad FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_custkey%7=0")
def edge_validity(spark, sf):
    """Symbols whose files were taken out of the node table are the invalid edges; tokens below them still have their symbol."""
    nodes = G.nodes(TB.tree(spark, sf))
    broken = nodes.where((F.col("kind") != "file") | (F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 7 != 0))
    return G.invalid_edges(broken).agg(F.count(F.lit(1)).alias("bad"))


@query(f"WITH {_JAVA} SELECT count(*) AS in_cycles FROM s WHERE k%5=0")
def tree_cycles(spark, sf):
    """Symbols that are made their own parents never reach an organisation."""
    nodes = G.nodes(samples(spark, sf).graph).where("repo = 'java' or repo is null").where("kind <> 'token'")
    damaged = (F.col("kind") == "symbol") & (F.regexp_extract("path", r"f(\d+)", 1).cast("int") % 5 == 0)
    return TR.cycles(nodes.withColumn("parent", F.when(damaged, F.col("key")).otherwise(F.col("parent")))).agg(F.count(F.lit(1)).alias("in_cycles"))


def register(put: Callable[[str, Callable, str], None]) -> None:
    for name, f in QUERIES.items():
        put(name, f, SQL[name])
