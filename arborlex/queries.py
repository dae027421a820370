"""The registered queries over the driver's tables, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sample_queries, store_queries
from .functions import columns as C
from .functions.patterns import parse
from .operators import catalog as K
from .operators import tree as TR
from .operators.scope import Rules, Scope, parse_policies, scoped
from .operators.search import Query, SymbolQuery, search, search_symbols
from .plans import graph as G
from .sources import tables as TB
from .streaming.ingest import latest_per_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text,''), '[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{N}_]*')"
_D = rf"d AS (SELECT source AS org, lang AS repo, 'doc/'||doc_id||'.txt' AS path, doc_id, unnest({_WORDS}) AS t FROM documents)"
_DL = rf"""l AS (SELECT source AS org, lang AS repo, 'doc/'||doc_id||'.txt' AS path, unnest(string_split(coalesce(text,''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text,''), chr(10)),1)-1 AS line FROM documents),
 dl AS (SELECT org, repo, path, line, unnest({_WORDS}) AS t FROM l)"""
_C = "c AS (SELECT c_custkey, r_name AS org, n_name AS repo, 'customer/'||c_custkey||'.tbl' AS path, lower(c_mktsegment) AS language FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"
_S = f"""{_C}, s AS (SELECT c.*, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS sidx, 'Order'||(o_orderkey%1000) AS name,
 CASE o_orderstatus WHEN 'F' THEN 'method' WHEN 'O' THEN 'function' ELSE 'type' END AS kind, o_orderpriority AS lang_kind, o_orderkey*100 AS st, o_orderkey*100+99 AS en FROM orders JOIN c ON o_custkey=c_custkey)"""
_T = f"""{_S}, t AS (SELECT s.org, s.repo, s.path, s.language, s.sidx, s.name, s.kind, s.lang_kind, s.st, s.en, s.o_orderkey, p_brand AS text, CASE l_returnflag WHEN 'R' THEN 'keyword' WHEN 'A' THEN 'identifier' ELSE 'literal' END AS class,
 l_orderkey*100+l_linenumber*10 AS start, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem JOIN part ON l_partkey=p_partkey JOIN s ON l_orderkey=o_orderkey)"""


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def brand(spark: SparkSession, sf: str) -> str:
    """The first brand there is; the tables' brands differ by scale."""
    return TB.table(spark, sf, "part").agg(F.min("p_brand")).first()[0]


_B = "(SELECT min(p_brand) FROM part)"
docs = TB.documents
tree = TB.tree


# -- tokens and roll-ups over documents -----------------------------------------------------------


@query(f"WITH {_D} SELECT org, repo, count(*) AS tokens, count(DISTINCT t) AS terms FROM d GROUP BY ALL")
def tokenize_words(spark, sf):
    return docs(spark, sf).tokens.groupBy("org", "repo").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("text").alias("terms"))


@query(f"WITH {_D} SELECT org, repo, path, CAST(count(*) AS BIGINT) AS count FROM d WHERE t='the' GROUP BY ALL")
def search_file(spark, sf):
    return search(docs(spark, sf), Query("the", "file")).select("org", "repo", F.col("file").alias("path"), "count")


@query(f"WITH {_D} SELECT org, repo, CAST(count(*) AS BIGINT) AS count FROM d WHERE t='the' GROUP BY ALL")
def search_repo(spark, sf):
    return search(docs(spark, sf), Query("the", "repo")).select("org", "repo", "count")


@query(f"WITH {_D} SELECT org, CAST(count(*) AS BIGINT) AS count FROM d WHERE t='the' GROUP BY ALL")
def search_org(spark, sf):
    return search(docs(spark, sf), Query("the", "org")).select("org", "count")


@query(f"WITH {_D} SELECT org, repo, CAST(count(*) AS BIGINT) AS count FROM d WHERE t='the' AND org='src1' GROUP BY ALL")
def search_org_repo_filter(spark, sf):
    return search(docs(spark, sf), Query("the", "repo", org="src1")).select("org", "repo", "count")


@query(f"WITH {_DL} SELECT org, repo, path, 'L'||line AS symbol, CAST(count(*) AS BIGINT) AS count FROM dl WHERE t='the' GROUP BY org, repo, path, line")
def search_symbol_line(spark, sf):
    return search(docs(spark, sf, with_lines=True), Query("the", "symbol")).select("org", "repo", F.col("file").alias("path"), "symbol", "count")


@query(f"WITH {_DL} SELECT org, repo, path, CAST(count(*) AS BIGINT) AS count, true AS no_matching_symbol FROM dl WHERE t='the' GROUP BY org, repo, path")
def search_method_no_match(spark, sf):
    return search(docs(spark, sf, with_lines=True), Query("the", "method")).select("org", "repo", F.col("file").alias("path"), "count", "no_matching_symbol")


@query(f"WITH {_D} SELECT org, repo, path, CAST(count(*) AS BIGINT) AS count, true AS no_symbols FROM d WHERE t='the' GROUP BY org, repo, path")
def search_no_symbols(spark, sf):
    return search(docs(spark, sf), Query("the", "symbol")).select("org", "repo", F.col("file").alias("path"), "count", "no_symbols")


@query(f"WITH {_D} SELECT t AS text, org, repo, path, CAST(count(*) AS BIGINT) AS count FROM d GROUP BY ALL")
def postings(spark, sf):
    return docs(spark, sf).postings.select("text", "org", "repo", "path", "count")


@query(f"WITH {_D}, p AS (SELECT t, path, count(*) AS n FROM d GROUP BY ALL) SELECT t AS text, count(*) AS files, CAST(sum(n) AS BIGINT) AS count FROM p GROUP BY t")
def term_dictionary(spark, sf):
    return K.dictionary(docs(spark, sf))


@query(f"WITH {_D}, b AS (SELECT DISTINCT unnest({_WORDS}) AS t FROM benchmark), a AS (SELECT DISTINCT t FROM d) SELECT count(*) FILTER (WHERE b.t IS NULL) AS only_documents, count(*) FILTER (WHERE a.t IS NULL) AS only_benchmark FROM a FULL JOIN b ON a.t=b.t")
def store_differential(spark, sf):
    a, b = docs(spark, sf).tokens.select("text").distinct(), docs(spark, sf, "benchmark").tokens.select("text").distinct()
    side = K.differences(a, b)
    return side.agg(F.count(F.when(F.col("side") == "left", 1)).alias("only_documents"), F.count(F.when(F.col("side") == "right", 1)).alias("only_benchmark"))


@query("SELECT 'doc/'||doc_id||'.txt' AS path, 'sha256:'||sha256(coalesce(text,''))||'|txt|0|1' AS fingerprint FROM documents")
def fingerprint(spark, sf):
    return docs(spark, sf).files.select("path", "fingerprint")


@query(f"WITH {_D} SELECT t AS name, CAST(count(*) AS BIGINT) AS count FROM d WHERE starts_with(translate(t,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'éa') OR contains(t,'ü') OR ends_with(t,'tion') GROUP BY ALL")
def pattern_matches(spark, sf):
    name = F.col("name")
    rows = docs(spark, sf).tokens.select(F.col("text").alias("name"))
    hit = parse("éa*").on(C.ascii_fold(name)) | parse("*ü*").on(name) | parse("*tion").on(name)
    return rows.where(hit).groupBy("name").agg(F.count(F.lit(1)).alias("count"))


@query("""SELECT source AS org, 'doc/'||documents.doc_id||'.txt' AS path FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) k ON documents.doc_id=k.doc_id WHERE k.doc_id IS NULL""")
def prune_plan(spark, sf):
    keep = TB.table(spark, sf, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return docs(spark, sf).files.where("origin = 'directory'").join(keep, "path", "left_anti").select("org", "path")


@query(f"WITH {_D}, f AS (SELECT source AS org, lang AS repo, count(*) AS files FROM documents WHERE source='src3' GROUP BY ALL), k AS (SELECT org, repo, count(*) AS tokens FROM d WHERE org='src3' GROUP BY ALL) SELECT f.org, f.repo, files, coalesce(tokens,0) AS tokens FROM f LEFT JOIN k ON f.org=k.org AND f.repo=k.repo")
def delete_scope_stats(spark, sf):
    return K.describe_by_scan(docs(spark, sf), org="src3").groupBy("org", "repo").agg(F.sum("files").alias("files"), F.sum("tokens").alias("tokens"))


@query(f"WITH {_D}, live AS (SELECT DISTINCT t FROM d WHERE org<>'src0') SELECT count(DISTINCT d.t) AS dead FROM d LEFT JOIN live ON d.t=live.t WHERE live.t IS NULL")
def vacuum_dead_terms(spark, sf):
    every = docs(spark, sf).tokens
    live = every.where("org <> 'src0'").select("text").distinct()
    return every.select("text").distinct().join(live, "text", "left_anti").agg(F.count(F.lit(1)).alias("dead"))


@query("""WITH a AS (SELECT doc_id, sha256(coalesce(text,'')) AS h FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN source='src0' THEN coalesce(text,'')||' ' ELSE coalesce(text,'') END) AS h FROM documents)
 SELECT count(*) FILTER (WHERE a.h=b.h) AS unchanged, count(*) FILTER (WHERE a.h<>b.h) AS changed FROM a JOIN b USING (doc_id)""")
def unchanged_files(spark, sf):
    stored = docs(spark, sf).files.select("path", "fingerprint")
    raw = TB.table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    body = F.when(F.col("source") == "src0", F.concat("t", F.lit(" "))).otherwise(F.col("t"))
    incoming = raw.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), C.fingerprint(body.cast("binary"), F.lit("txt"), F.lit(0)).alias("now"))
    same = incoming.join(stored, "path").select((F.col("now") == F.col("fingerprint")).alias("same"))
    return same.agg(F.count(F.when(F.col("same"), 1)).alias("unchanged"), F.count(F.when(~F.col("same"), 1)).alias("changed"))


@query(f"WITH {_D} SELECT CAST(conv_id AS VARCHAR) AS repo, role AS language, count(*) AS tokens FROM (SELECT conv_id, lower(role) AS role, unnest({_WORDS}) AS t FROM conversations) GROUP BY ALL")
def conversation_tokens(spark, sf):
    return TB.conversations(spark, sf).tokens.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("tokens"))


# -- the exact tree -----------------------------------------------------------------------------


@query(f"WITH {_T} SELECT org, repo, path, name AS symbol, kind AS symbol_kind, class AS token_class, start, count(*) AS n FROM t WHERE text={_B} GROUP BY ALL")
def search_token(spark, sf):
    hits = search(tree(spark, sf), Query(brand(spark, sf)))
    return hits.groupBy("org", "repo", F.col("file").alias("path"), "symbol", "symbol_kind", "token_class", "start").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_T} SELECT org, repo, path, start FROM t WHERE text={_B} ORDER BY org, repo, path, start, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax LIMIT 50 OFFSET 25")
def search_token_limit_offset(spark, sf):
    return search(tree(spark, sf), Query(brand(spark, sf), limit=50, offset=25)).select("org", "repo", F.col("file").alias("path"), "start")


_SYMBOLIC = "SELECT org, repo, path, name AS symbol, kind AS symbol_kind, st AS start, CAST(count(*) AS BIGINT) AS count, false AS no_matching_symbol FROM t WHERE text={b} AND {ok} GROUP BY org, repo, path, name, kind, st UNION ALL SELECT org, repo, path, NULL, NULL, NULL, count(*), true FROM t WHERE text={b} AND NOT ({ok}) GROUP BY org, repo, path"
_symbolic = lambda hits: hits.select("org", "repo", F.col("file").alias("path"), "symbol", "symbol_kind", "start", "count", "no_matching_symbol")


@query(f"WITH {_T} " + _SYMBOLIC.format(b=_B, ok="kind IN ('method','function')"))
def search_method(spark, sf):
    return _symbolic(search(tree(spark, sf), Query(brand(spark, sf), "method")))


@query(f"WITH {_T} " + _SYMBOLIC.format(b=_B, ok="kind='type'"))
def search_class(spark, sf):
    return _symbolic(search(tree(spark, sf), Query(brand(spark, sf), "class")))


@query(f"WITH {_T} " + _SYMBOLIC.format(b=_B, ok="lang_kind='2-HIGH'"))
def search_symbol_kind_filter(spark, sf):
    return _symbolic(search(tree(spark, sf), Query(brand(spark, sf), "symbol", symbol_kind="2-high")))


@query(f"WITH {_T} SELECT org, repo, CAST(count(*) AS BIGINT) AS count FROM t WHERE text={_B} AND class='keyword' GROUP BY ALL")
def search_class_filter(spark, sf):
    return search(tree(spark, sf), Query(brand(spark, sf), "repo", token_class="keyword")).select("org", "repo", "count")


@query(f"WITH {_T} SELECT org, repo, path, CAST(count(*) AS BIGINT) AS count FROM t WHERE text={_B} AND language='machinery' GROUP BY ALL")
def search_language_filter(spark, sf):
    return search(tree(spark, sf), Query(brand(spark, sf), "file", language="MACHINERY")).select("org", "repo", F.col("file").alias("path"), "count")


def _symbols(sql_where: str, **how):
    text = f"WITH {_S} SELECT org, repo, path, name, kind, lang_kind, st AS start FROM s WHERE {sql_where}"

    def run(spark, sf):
        return search_symbols(tree(spark, sf), SymbolQuery(**how)).select("org", "repo", F.col("file").alias("path"), "name", "kind", "lang_kind", "start")

    return text, run


for _name, _where, _how in (
    ("symbols_exact", "name='Order7'", {"pattern": "order7"}),
    ("symbols_prefix", "starts_with(name,'Order12')", {"pattern": "ORDER12*"}),
    ("symbols_infix", "contains(name,'er9')", {"pattern": "*ER9*"}),
    ("symbols_suffix", "ends_with(name,'77')", {"pattern": "*77"}),
    ("symbols_exact_case", "starts_with(name,'Order1')", {"pattern": "Order1*", "exact_case": True}),
    ("symbols_exact_case_none", "starts_with(name,'order1')", {"pattern": "order1*", "exact_case": True}),
    ("symbols_kind", "kind='method'", {"pattern": "*", "kind": "METHOD"}),
    ("symbols_lang_kind", "lang_kind='1-URGENT'", {"pattern": "*", "kind": "1-urgent"}),
    ("symbols_file", "path='customer/1.tbl'", {"pattern": "*", "file": "./customer//x/../1.tbl"}),
    ("symbols_org_language", "org='ASIA' AND language='machinery'", {"pattern": "*", "org": "ASIA", "language": "Machinery"}),
):
    SQL[_name], QUERIES[_name] = _symbols(_where, **_how)


@query(f"WITH {_S} SELECT org, repo, path, name, st AS start FROM s WHERE kind='type' ORDER BY org, repo, path, st, name LIMIT 100 OFFSET 10")
def symbols_limit_offset(spark, sf):
    return search_symbols(tree(spark, sf), SymbolQuery("*", kind="type", limit=100, offset=10)).select("org", "repo", F.col("file").alias("path"), "name", "start")


@query(f"WITH {_DL}, w AS (SELECT DISTINCT org, repo, path, line FROM dl) SELECT org, repo, path, 'L'||line AS name, line+1 AS name_line FROM w")
def symbol_name_pos(spark, sf):
    rows = search_symbols(docs(spark, sf, with_lines=True), SymbolQuery("L*", exact_case=True))
    return rows.select("org", "repo", F.col("file").alias("path"), "name", "name_line")


_DESCRIBE = f"""WITH {_T}, f AS (SELECT org, repo, language, count(*) AS files FROM c GROUP BY ALL), y AS (SELECT org, repo, language, count(*) AS symbols FROM s GROUP BY ALL), k AS (SELECT org, repo, language, count(*) AS tokens FROM t GROUP BY ALL)
 SELECT f.org, f.repo, f.language, files, coalesce(symbols,0) AS symbols, coalesce(tokens,0) AS tokens FROM f LEFT JOIN y ON f.org=y.org AND f.repo=y.repo AND f.language=y.language LEFT JOIN k ON f.org=k.org AND f.repo=k.repo AND f.language=k.language"""


@query(_DESCRIBE)
def describe(spark, sf):
    return K.describe(tree(spark, sf))


@query(_DESCRIBE)
def describe_by_scan(spark, sf):
    return K.describe_by_scan(tree(spark, sf))


@query(f"WITH {_S} SELECT org, repo, kind||'/'||lang_kind AS label, CAST(count(*) AS BIGINT) AS count FROM s GROUP BY ALL")
def describe_symbol_kinds(spark, sf):
    return K.labels(tree(spark, sf), "symbol_kind")


@query(f"WITH {_T} SELECT org, repo, class AS label, CAST(count(*) AS BIGINT) AS count FROM t GROUP BY ALL")
def token_class_counts(spark, sf):
    return K.labels(tree(spark, sf), "token_class")


@query(f"WITH {_T} SELECT 'org' AS kind, count(DISTINCT org) AS count FROM c UNION ALL SELECT 'repo', count(DISTINCT org||'/'||repo) FROM c UNION ALL SELECT 'file', count(*) FROM c UNION ALL SELECT 'symbol', count(*) FROM s UNION ALL SELECT 'token', count(*) FROM t")
def count_nodes(spark, sf):
    return K.count_nodes(tree(spark, sf))


@query(f"WITH {_S} SELECT count(DISTINCT name) AS names FROM s")
def distinct_names(spark, sf):
    return tree(spark, sf).symbols.agg(F.countDistinct("name").alias("names"))


@query(f"WITH {_C} SELECT DISTINCT org, repo FROM c WHERE org='EUROPE'")
def list_repos(spark, sf):
    return K.list_repos(tree(spark, sf), "EUROPE")


@query(f"WITH {_C} SELECT org, repo, path FROM c WHERE starts_with(path,'customer/1') AND org='ASIA' AND repo=(SELECT min(repo) FROM c WHERE org='ASIA')")
def list_files_prefix(spark, sf):
    g = tree(spark, sf)
    repo = g.files.where("org = 'ASIA'").agg(F.min("repo")).first()[0]
    return K.list_files(g, "ASIA", repo or "", "customer/1").select("org", "repo", "path")


@query(f"WITH {_S} SELECT name, kind, st AS start, en AS \"end\", sidx FROM s WHERE c_custkey=4")
def file_outline(spark, sf):
    g = tree(spark, sf)
    at = g.files.where("path = 'customer/4.tbl'").select("org", "repo").first()
    return K.file_outline(g, at["org"], at["repo"], "customer/4.tbl").select("name", "kind", "start", "end", F.col("sidx").cast("bigint").alias("sidx"))


@query(f"WITH {_T} SELECT text, class, start FROM t WHERE path='customer/4.tbl' AND o_orderkey BETWEEN 0 AND 5000")
def file_tokens_range(spark, sf):
    g = tree(spark, sf)
    at = g.files.where("path = 'customer/4.tbl'").select("org", "repo").first()
    return K.file_tokens(g, at["org"], at["repo"], "customer/4.tbl", 0, 5000).select("text", "class", "start")


@query(f"WITH {_C}, r AS (SELECT DISTINCT repo FROM c WHERE org='AFRICA') SELECT 'repo' AS kind, repo AS name FROM r")
def tree_children(spark, sf):
    return TR.children(G.nodes(tree(spark, sf)), "org/AFRICA").select("kind", "name")


@query(f"WITH {_C} SELECT 'repo' AS kind, repo AS name FROM c WHERE c_custkey=3")
def tree_parent(spark, sf):
    all_nodes = G.nodes(tree(spark, sf))
    key = all_nodes.where("kind = 'file' and path = 'customer/3.tbl'").select("key").first()[0]
    return TR.parent(all_nodes, key).select("kind", "name")


@query(f"WITH {_S}, x AS (SELECT * FROM s WHERE c_custkey=4 AND sidx=0) SELECT 'file' AS kind, path AS name FROM x UNION ALL SELECT 'repo', repo FROM x UNION ALL SELECT 'org', org FROM x")
def tree_ancestors(spark, sf):
    g = tree(spark, sf)
    at = g.files.where("path = 'customer/4.tbl'").select("org", "repo").first()
    return TR.ancestors(g, "symbol", at["org"], at["repo"], "customer/4.tbl", 0).select("kind", "name")


@query(f"""WITH {_T}, x AS (SELECT 'symbol' AS kind, name, st AS start, en AS fin, 0 AS tok, 0 AS o FROM s WHERE c_custkey=4 UNION ALL
 SELECT 'token', text, start, start+5, 1, row_number() OVER (ORDER BY start, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) FROM t WHERE path='customer/4.tbl')
 SELECT kind, name, start FROM x ORDER BY start, tok, fin DESC, o LIMIT 20 OFFSET 1""")
def tree_descendants_page(spark, sf):
    all_nodes = G.nodes(tree(spark, sf))
    key = all_nodes.where("kind = 'file' and path = 'customer/4.tbl'").select("key").first()[0]
    return TR.descendants(all_nodes, key, offset=1, limit=20).select("kind", "name", "start")


@query(f"WITH {_C} SELECT DISTINCT 'org' AS kind, org AS name FROM c")
def tree_roots(spark, sf):
    return TR.roots(G.nodes(tree(spark, sf))).select("kind", "name")


@query(f"WITH {_T} SELECT org, repo, path, start, o_orderkey, count(*) AS n FROM t GROUP BY ALL")
def containment_build(spark, sf):
    g = tree(spark, sf)
    items = g.tokens.select(*G.FILE_KEY, "ordinal", "start")
    parents = G.containment(g.symbols, items, G.FILE_KEY, "ordinal").join(items, [*G.FILE_KEY, "ordinal"])
    named = parents.join(g.symbols.select(*G.FILE_KEY, F.col("sidx").alias("parent_sidx"), (F.col("start") / 100).cast("bigint").alias("o_orderkey")), [*G.FILE_KEY, "parent_sidx"])
    return named.groupBy(*G.FILE_KEY, "start", "o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_T} SELECT org, repo, CAST(count(*) AS BIGINT) AS count FROM t WHERE text={_B} AND (org='ASIA' OR org='EUROPE') AND repo<>'CHINA' GROUP BY ALL")
def scoped_search(spark, sf):
    rules = Rules(orgs=frozenset({"ASIA", "EUROPE"}), deny_repos=frozenset({("ASIA", "CHINA")}))
    return search(scoped(tree(spark, sf), Scope((rules,))), Query(brand(spark, sf), "repo")).select("org", "repo", "count")


@query(f"WITH {_C} SELECT org, repo, language, count(*) AS files FROM c WHERE org='AMERICA' GROUP BY ALL")
def scoped_describe(spark, sf):
    from .operators.scope import Principal, compile_scope

    policies = parse_policies('permit(principal in Group::"readers", action, resource in Org::"AMERICA");')
    scope = compile_scope(policies, Principal("t", frozenset({"readers"})), "read")
    return K.describe_by_scan(scoped(tree(spark, sf), scope)).select("org", "repo", "language", "files")


@query(f"WITH {_S} SELECT org, repo, language, (SELECT count(*) FROM c WHERE c.org=s.org AND c.repo=s.repo AND c.language=s.language) AS files, count(*) AS symbols FROM s WHERE language<>'machinery' GROUP BY ALL")
def extractor_gaps(spark, sf):
    return K.extractor_gaps(tree(spark, sf), ["machinery"])


@query(f"WITH {_T} SELECT 'org' AS kind, org AS name, count(*) AS n FROM c GROUP BY org UNION ALL SELECT 'token', text, count(*) FROM t GROUP BY text")
def export_nodes(spark, sf):
    lines = G.nodes(tree(spark, sf)).select(F.to_json(F.struct("kind", "name", "path")).alias("line"))
    back = lines.select(F.from_json("line", "kind string, name string, path string").alias("n")).select("n.*")
    files = tree(spark, sf).files.groupBy(F.lit("org").alias("kind"), F.col("org").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return files.unionByName(back.where("kind = 'token'").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1")
def stream_upsert(spark, sf):
    events = TB.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return latest_per_key(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, CAST(max(event_id) AS BIGINT) AS event_id FROM events GROUP BY user_id")
def upsert_last_wins(spark, sf):
    rows = TB.table(spark, sf, "events").select("user_id", "event_id")
    return latest_per_key(rows.withColumn("version", F.col("event_id")), ["user_id"], ["version"]).select("user_id", "event_id")


# -- paths and languages (values made from rows, so that SQL can state the answer) ------------------


@query("""SELECT page_id, 'a/'||page_id||'/c.py' AS path, 'python' AS language FROM pages UNION ALL SELECT page_id, '/'||page_id AS path, 'unknown' FROM pages UNION ALL SELECT page_id, '../'||page_id||'.tar.GZ', 'gz' FROM pages""")
def normalize_paths(spark, sf):
    p = TB.table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("s"))
    made = F.explode(F.array(F.concat(F.lit(".\\a//"), "s", F.lit("/b/../c.py")), F.concat(F.lit("/../x/../"), "s"), F.concat(F.lit("x/../../"), "s", F.lit(".tar.GZ"))))
    paths = p.select("page_id", made.alias("raw"))
    return paths.select("page_id", C.normalize_path(F.col("raw")).alias("path"), C.detect_language(F.col("raw")).alias("language"))


@query("""SELECT doc_id, CASE doc_id%5 WHEN 0 THEN 'python' WHEN 1 THEN 'shell' WHEN 2 THEN 'make' WHEN 3 THEN 'javascript' ELSE 'unknown' END AS language FROM documents""")
def detect_language(spark, sf):
    k = F.col("doc_id") % 5
    d = TB.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.when(k == 2, "src/Makefile").otherwise("bin/tool").alias("path"), F.when(k == 0, "#!/usr/bin/env -S python3.11 -u\n").when(k == 1, "#! /bin/bash\n").when(k == 3, "#!/usr/local/bin/node\n").otherwise("").alias("head"))
    return d.select("doc_id", C.detect_language_from_content(F.col("path"), F.concat("head", "t")).alias("language"))


# -- extractors: no SQL form -----------------------------------------------------------------------


@query()
def html_symbols(spark, sf):
    return search_symbols(TB.pages(spark, sf), SymbolQuery("*")).select("org", "repo", "file", "name", "lang_kind", "start", "end")


# markup: comments, tags with their values, and the text between are cut apart first, as quotes mean something in tags only
_HTML = r"""h AS (SELECT coalesce(nullif(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), ''), 'none') AS org, coalesce(html,'') AS t FROM pages),
 g AS (SELECT org, unnest(regexp_extract_all(t, '(?s:<!--.*?(?:-->|\z))|<[\p{L}/!?](?:"[^"]*"|''[^'']*''|[^''"<>])*>?|<|[^<]+')) AS g FROM h),
 k AS (SELECT org, g, starts_with(g,'<!--') AS comment, regexp_matches(g, '^<[\p{L}/!?]') AS tag FROM g),
 x AS (SELECT org, tag, unnest(CASE WHEN comment THEN [g] WHEN tag THEN regexp_extract_all(g, '[\p{L}_][\p{L}\p{N}_]*(?:[-:][\p{L}\p{N}_]+)*|[0-9](?:[\p{L}\p{N}_.]*[\p{L}\p{N}_])?|"[^"]*"|''[^'']*''|[^\s\p{Z}\x0B\x{85}\x{FEFF}]')
  ELSE regexp_extract_all(g, '[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{N}_]*|[0-9](?:[\p{L}\p{N}_.]*[\p{L}\p{N}_])?|[^\s\p{Z}\x0B\x{85}\x{FEFF}]') END) AS x FROM k),
 c AS (SELECT org, CASE WHEN starts_with(x,'<!--') THEN 'comment' WHEN regexp_matches(x, '^[\p{L}\p{Nl}_]') THEN 'identifier' WHEN regexp_matches(x, '^[0-9]') OR length(x)>1 THEN 'literal' WHEN contains('+-*/%=<>!&|^~?@', x) THEN 'operator' ELSE 'punctuation' END AS class FROM x)"""


@query(f"WITH {_HTML} SELECT org, class, count(*) AS count FROM c GROUP BY ALL")
def html_tokens(spark, sf):
    return TB.pages(spark, sf).tokens.groupBy("org", "class").agg(F.count(F.lit(1)).alias("count"))


def _declared(spark: SparkSession):
    from .plans.build import graph_from_declarations

    def sym(name, kind, start, end, owner=None, lang=None):
        return {"name": name, "kind": kind, "lang_kind": lang, "owner": owner, "start": start, "end": end, "start_line": 1, "start_col": start + 1, "end_line": 1, "end_col": end + 1}

    def tok(text, start):
        return {"text": text, "class": "identifier", "start": start, "end": start + len(text), "start_line": 1, "start_col": start + 1, "end_line": 1, "end_col": start + len(text) + 1}

    return graph_from_declarations(spark, [
        {"org": "o", "repo": "r", "path": "p/a.go", "language": "go", "symbols": [sym("T", "type", 0, 10, lang="struct"), sym("M", "method", 20, 40, "T")], "tokens": [tok("foo", 2), tok("foo", 25), tok("foo", 30)]},
        {"org": "o", "repo": "r", "path": "p/b.go", "language": "go", "symbols": [sym("N", "method", 0, 20, "T"), sym("K", "method", 30, 50, "Gone")], "tokens": [tok("foo", 5), tok("foo", 35)]},
        {"org": "o", "repo": "r", "path": "q/c.go", "language": "go", "symbols": [sym("Q", "method", 0, 20, "T")], "tokens": [tok("foo", 5)]},
    ])


@query("SELECT 'p/a.go' AS path, 'T' AS symbol, CAST(4 AS BIGINT) AS count, false AS no_matching_symbol UNION ALL SELECT 'p/b.go', NULL, 1, true UNION ALL SELECT 'q/c.go', NULL, 1, true")
def owner_sibling_file(spark, sf):
    return search(_declared(spark), Query("foo", "class")).select(F.col("file").alias("path"), "symbol", "count", "no_matching_symbol")


@query("SELECT 'p/a.go' AS path, 'T' AS symbol, CAST(3 AS BIGINT) AS count")
def owner_same_file(spark, sf):
    g = _declared(spark)
    here = G.Graph(*(df.where("path = 'p/a.go'") for df in (g.files, g.symbols, g.tokens))).with_derived()
    return search(here, Query("foo", "class")).select(F.col("file").alias("path"), "symbol", "count")


def _put(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


sample_queries.register(_put)
store_queries.register(_put)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
