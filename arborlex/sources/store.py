"""A versioned store of the graph: immutable Parquet segments and numbered manifests.

A commit writes one segment (the tables of the files it adds, and the keys of
those it removes) and then a manifest that lists all segments.  The newest
segment that names a file decides about it; older rows drop out by a semi
join with the live keys.  A manifest is created exclusively, so of two
concurrent writers one fails; a reader pins a manifest, which is a snapshot.
``compact`` rewrites the live rows into one segment and then deletes segments
that no manifest names which a snapshot may still hold.  Tables are partitioned
by organisation and repository, so a query for one reads that one only; where
whole repositories are all that is dead, a manifest leaves their partitions out
and the segment stays.

Contents are brought into order before they are parsed, so what comes of them
(tokens take far more room) is written without a shuffle.  Tokens are stored
packed: spans as differences from what their text and start imply, as deltas.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..functions.extract import Registry
from ..functions.languages import default_registry
from ..operators import catalog as K
from ..plans.build import counters_of, graph_from_declarations, graph_of, prepare
from ..plans.graph import FILE_KEY, Graph, postings

TABLES = {"files": S.FILES, "symbols": S.SYMBOLS, "tokens": S.TOKENS, "postings": S.POSTINGS, "counters": S.COUNTERS}
#: What each table is sorted by inside its files, so that row groups are skipped by their statistics.
SORTED = {"files": FILE_KEY, "symbols": ["name_fold", *FILE_KEY], "tokens": [*FILE_KEY, "ordinal"], "postings": ["text", *FILE_KEY], "counters": FILE_KEY}
PARTS = ["org", "repo"]
#: Folders other than the table's name; a segment without that folder holds the table as it is.
PACKED = {"tokens": "strided/packed"}
#: Up to a query's end its shuffle files stay; without this until the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Contents of about so many bytes are parsed by one task.
PARSE_BYTES = 4 << 20
#: An upsert stages about so many bytes of contents at once, or one of MOST_PIECES parts of more.
PIECE_BYTES = 64 << 20
MOST_PIECES = 8
#: Up to so many dead files, besides those of repositories that are dead as a whole, are sent to all executors.
MOST_DEAD = 100_000
#: A manifest leaves out up to so many repositories of a segment; where more are dead, the live rows are rewritten.
MOST_DROPPED = 1_000
_SPAN_COLUMNS = ("ordinal", "parent_sidx", *S.SPAN, "first_tok", "last_tok")


def _compact(df: DataFrame, nested: str = "") -> DataFrameWriter:
    """A writer of Parquet whose spans are deltas; ``nested``: of an array of structs."""
    out = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").option("parquet.writer.version", "v2")
    for c in _SPAN_COLUMNS:
        out = out.option(f"parquet.enable.dictionary#{nested}{c}", "false")
    return out


def _implied() -> dict[str, F.Column]:
    """By column, what a token's text and the columns before it imply; nulls count as 0, so adding it again is exact."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    start, line, col, text = F.col("start"), F.col("start_line"), F.col("start_col"), F.col("text")
    return {"end": zero(start) + zero(F.octet_length(text)), "end_line": zero(line), "start_col": zero(start), "end_col": zero(col) + zero(F.char_length(text))}


def in_order(spark: SparkSession) -> SparkSession:
    """A session that reads each file in one task, and writes partitions side by side: rows stay in their files' order, unsorted."""
    out = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            out.conf.set(k, v)
    for k in ("files.maxPartitionBytes", "files.openCostInBytes"):
        out.conf.set(f"spark.sql.{k}", str(1 << 30))
    out.conf.set("spark.sql.maxConcurrentOutputFileWriters", "32")  # rows of further partitions are sorted
    return out


def _stride() -> F.Column:
    return F.coalesce(F.col("ordinal"), F.lit(0)).cast("bigint") * S.STRIDE


@contextmanager
def tidy(*sessions: SparkSession):
    """Inside, shuffle files go when the query that wrote them ends. What is made inside is written once, then read from there."""
    before = [(s, s.conf.get(TIDY, None)) for s in sessions]
    try:
        for s in sessions:
            s.conf.set(TIDY, "true")
        yield
    finally:
        for s, old in reversed(before):
            s.conf.unset(TIDY) if old is None else s.conf.set(TIDY, old)


def pack(tokens: DataFrame) -> DataFrame:
    """Spans less what is implied; of start_col, the place where its line starts, counted from 1."""
    less = {c: F.col(c) - x for c, x in _implied().items()}
    return tokens.withColumns(less | {"start": F.col("start") - _stride(), "start_col": 2 - less["start_col"] - _stride()})


def unpack(packed: DataFrame) -> DataFrame:
    packed = packed.withColumns({"start": F.col("start") + _stride(), "start_col": 2 - F.col("start_col") - _stride()})
    return _unpacked(packed)


def _unpacked(packed: DataFrame) -> DataFrame:
    """Of tokens that were packed without strides: segments written by earlier versions."""
    first, then = ("end", "end_line", "start_col"), ("end_col",)  # end_col builds on start_col
    for names in (first, then):
        packed = packed.withColumns({c: F.col(c) + _implied()[c] for c in names})
    return packed


SNAPSHOT_SECONDS = 15 * 60


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; only a local session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="arborlex-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _count_runs(batches):
    """How often each text comes in each run of one file's rows."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        last = rows.slice(rows.num_rows - 1).select(FILE_KEY).to_pylist()[0]
        of_last = reduce(pc.and_, (pc.equal(rows.column(c), last[c]) for c in FILE_KEY))
        held, rows = rows.filter(of_last), rows.filter(pc.invert(of_last))
        if rows.num_rows:
            yield from _counted(rows)
    if held is not None:
        yield from _counted(held)


def _counted(rows: pa.Table):
    out = rows.group_by([*FILE_KEY, "text"]).aggregate([([], "count_all")])
    return out.rename_columns([{"count_all": "count"}.get(c, c) for c in out.column_names]).select([*FILE_KEY, "text", "count"]).to_batches()


class Conflict(RuntimeError):
    """Another writer committed first."""


class SnapshotExpired(RuntimeError):
    pass


@dataclass
class Manifest:
    version: int = 0
    schema_version: int = S.SCHEMA_VERSION
    segments: list[str] = field(default_factory=list)
    open_batch: bool = False
    stream_batches: dict[str, int] = field(default_factory=dict)
    next_seq: int = 0
    #: By segment, its repositories (org, repo) that are left out.
    dropped: dict[str, list[list[str]]] = field(default_factory=dict)


def _without(rows: DataFrame, parts: list[list[str]] | None) -> DataFrame:
    """Rows but for those of some repositories; as a condition on partitions, so their files aren't opened."""
    return rows.where(~F.concat_ws("\0", *PARTS).isin(["\0".join(p) for p in parts])) if parts else rows


def segment_rows(prepared: DataFrame) -> dict[str, DataFrame]:
    g = graph_of(prepared)
    counters = prepared.where("status = 'ok'").select(*FILE_KEY, "language", F.explode("counters").alias("c")).select(*FILE_KEY, "language", "c.*")
    return {"files": g.files, "symbols": g.symbols, "tokens": g.tokens, "postings": g.postings, "counters": counters}


def file_counters(g: Graph) -> DataFrame:
    """Counters by file from the base tables."""
    by = [*FILE_KEY, "language"]
    count = lambda df, what, label: df.groupBy(*by, label.alias("label")).agg(F.count(F.lit(1)).alias("count")).select(*by, F.lit(what).alias("what"), "label", "count")
    none = F.lit("")
    parts = [
        count(g.files, "files", none), count(g.symbols, "symbol_kind", C.kind_label(F.col("kind"), F.col("lang_kind"))), count(g.tokens, "token_class", F.col("class")),
        count(g.files.where("encoding <> 'UTF-8'"), "encoding", F.col("encoding")), count(g.files.where("lossy"), "lossy", none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str, registry: Registry | None = None, pinned: Manifest | None = None):
        self.spark, self.root, self.registry = spark, root.rstrip("/"), registry or default_registry()
        self.pinned, self.pinned_at = pinned, time.time()

    # files, through Hadoop's file system: any store that Spark knows

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def manifest(self) -> Manifest:
        if self.pinned is not None:
            if time.time() - self.pinned_at > SNAPSHOT_SECONDS:
                raise SnapshotExpired("the snapshot is older than 15 minutes")
            return self.pinned
        names = self._names()
        return self._read_manifest(names[-1]) if names else Manifest()

    def _read_manifest(self, version: int) -> Manifest:
        text = self.spark.read.text(f"{self.root}/manifests/{version:08d}.json", wholetext=True).first()[0]
        found = Manifest(**json.loads(text))
        if found.schema_version != S.SCHEMA_VERSION:
            raise ValueError(f"schema version {found.schema_version} is not {S.SCHEMA_VERSION}")
        return found

    def detect_format(self) -> int | None:
        """The schema version of the newest manifest, or None if there is no store."""
        names = self._names()
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{names[-1]:08d}.json", wholetext=True).first()[0])["schema_version"] if names else None

    def _commit(self, m: Manifest) -> Manifest:
        if self.pinned is not None:
            raise RuntimeError("a snapshot is read-only")
        m.version += 1
        m.dropped = {s: m.dropped[s] for s in m.segments if m.dropped.get(s)}
        fs, p = self._fs(f"{self.root}/manifests/{m.version:08d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise Conflict(f"version {m.version} exists already") from e
        said = {k: v for k, v in m.__dict__.items() if v or k != "dropped"}  # earlier versions refuse what they don't know
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return m

    def snapshot(self) -> Store:
        return Store(self.spark, self.root, self.registry, self.manifest())

    # reading

    def _dead(self, m: Manifest) -> tuple[list[tuple[DataFrame, list[str]]], bool]:
        """What newer segments name, as (rows, columns): repositories of a segment that are dead as a whole, and the other dead files.

        And whether the latter are few.  Nothing if one segment holds everything.
        """
        if len(m.segments) <= 1:
            return [], True
        keys = None
        for n, s in enumerate(m.segments):
            part = _without(self.spark.read.parquet(f"{self.root}/segments/{s}/keys"), m.dropped.get(s)).select(*FILE_KEY, "gone", F.lit(n).alias("nth"))
            keys = part if keys is None else keys.unionByName(part)
        by = keys.groupBy(*FILE_KEY).agg(F.max("nth").alias("last"), F.collect_list(F.when(~F.col("gone"), F.col("nth"))).alias("held"))
        held = by.select(*FILE_KEY, F.explode("held").alias("nth"), "last")
        parts = [*PARTS, "nth"]
        whole = held.groupBy(*parts).agg(F.max(F.col("nth") == F.col("last")).alias("lives")).where("not lives").select(*parts)
        dead = held.where("nth < last").select(*FILE_KEY, "nth").join(F.broadcast(whole), parts, "left_anti")
        # a few are sent to where the rows are, which then stay there
        few = dead.limit(MOST_DEAD + 1).count() <= MOST_DEAD
        return [(F.broadcast(whole), parts), (F.broadcast(dead) if few else dead, [*FILE_KEY, "nth"])], few

    def graph(self) -> Graph:
        m = self.manifest()
        return self._graph(m)

    def _counters(self) -> DataFrame:
        m = self.manifest()
        return self._read(m, self._dead(m)[0], "counters")

    def _graph(self, m: Manifest) -> Graph:
        dead, _ = self._dead(m)

        def read(name: str) -> DataFrame:
            return self._read(m, dead, name)

        base = [read(n) for n in ("files", "symbols", "tokens", "postings")]
        return Graph(*base, counters_of(read("counters")))

    def _part(self, segment: str, name: str, dropped: list[list[str]] | None = None) -> DataFrame:
        schema = TABLES[name]
        forms = [(PACKED[name], unpack), ("packed", _unpacked)] if name in PACKED else []
        for folder, plain in [*forms, (name, lambda df: df)]:
            path = f"{self.root}/segments/{segment}/{folder}"
            fs, p = self._fs(path)
            if fs.exists(p):
                break
        if not any(f.isDirectory() for f in fs.listStatus(p)):  # no partition: no rows
            return self.spark.createDataFrame([], schema)
        found = _without(self.spark.read.schema(schema).parquet(path), dropped)
        return plain(found).select(*schema.names)

    def _read(self, m: Manifest, dead: list[tuple[DataFrame, list[str]]], name: str) -> DataFrame:
        schema = TABLES[name]
        out = None
        for n, s in enumerate(m.segments):
            part = self._part(s, name, m.dropped.get(s)).withColumn("nth", F.lit(n))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], schema)
        for rows, by in dead:
            out = out.join(rows, by, "left_anti")
        return out.select(*schema.names)

    def _holders(self, m: Manifest) -> list[str]:
        """The segments that hold files."""
        found = []
        for s in m.segments:
            fs, p = self._fs(f"{self.root}/segments/{s}/files")
            found += [s] * any(f.isDirectory() for f in fs.listStatus(p))
        return found

    def _scattered(self, m: Manifest) -> bool:
        """Whether more than one segment holds files; those of a single one lie together already."""
        return len(self._holders(m)) > 1

    def _droppable(self, m: Manifest) -> list[list[str]] | None:
        """Repositories without which the one segment that holds files has nothing dead; None if there is no such segment, or too many of them."""
        held = self._holders(m)
        if len(held) != 1 or any(not fs.exists(p) for fs, p in (self._fs(f"{self.root}/segments/{held[0]}/{f}") for f in PACKED.values())):
            return None
        dead, few = self._dead(m)
        if not dead:
            return []
        (whole, _), (others, _) = dead
        if not few or others.take(1):
            return None
        found = whole.select(*PARTS).limit(MOST_DROPPED + 1).collect()  # no other segment holds any
        return [[*r] for r in found] if len(found) + len(m.dropped.get(held[0], [])) <= MOST_DROPPED else None

    def _rows(self) -> dict[str, DataFrame]:
        g = self.graph()
        return {n: getattr(g, n) for n in ("files", "symbols", "tokens", "postings")} | {"counters": self._counters()}

    # writing

    def _write_segment(self, rows: dict[str, DataFrame] | None, gone: DataFrame | None, clustered: bool = False, arranged: tuple[str, ...] | None = None) -> str:
        """A new segment with these rows and the keys of those that are gone."""
        name = uuid.uuid4().hex
        self._write_tables(name, rows, clustered, arranged)
        self._write_keys(name, gone)
        return name

    def _write_tables(self, name: str, rows: dict[str, DataFrame] | None, clustered: bool = False, arranged: tuple[str, ...] | None = None, packed: bool = False) -> None:
        """Adds rows to a segment; ``arranged``: they come as a session of :func:`in_order` reads them, those of one repository together, and those of these tables sorted; ``packed``: the tokens are packed already."""
        base = f"{self.root}/segments/{name}"

        def write(table: str) -> None:
            schema = TABLES[table]
            df = rows[table].select(*schema.names) if rows is not None else self.spark.createDataFrame([], schema)
            inner = [c for c in SORTED[table] if c not in PARTS]
            # a compaction brings what is read together into the same files; else rows of one repository come together,
            # and adaptive execution splits a large one
            if arranged is None:
                df = df.repartitionByRange(*PARTS, *inner) if clustered else df.hint("rebalance", *PARTS)
            if table not in (arranged or ()):
                df = df.sortWithinPartitions(*PARTS, *inner)
            out = _compact(pack(df) if table in PACKED and not packed else df)
            if table == "postings":  # sorted texts: each is stored as what differs from the one before
                out = out.option("parquet.enable.dictionary#text", "false")
            out.mode("append").partitionBy(*PARTS).parquet(f"{base}/{PACKED.get(table, table)}")

        with ThreadPoolExecutor(len(TABLES)) as pool:  # the tables' jobs share the executors
            list(pool.map(write, TABLES))

    def _write_keys(self, name: str, gone: DataFrame | None) -> None:
        empty = self.spark.createDataFrame([], ", ".join(f"{c} string" for c in FILE_KEY))
        added = self._part(name, "files").select(*FILE_KEY, F.lit(False).alias("gone"))
        removed = (gone if gone is not None else empty).select(*FILE_KEY, F.lit(True).alias("gone"))
        added.unionByName(removed.join(added, FILE_KEY, "left_anti")).write.parquet(f"{self.root}/segments/{name}/keys")

    def _pieces(self, heads: DataFrame, total: int) -> list[F.Column]:
        """Conditions that part files (file key, own_bytes) by ranges of their keys into pieces of about equal bytes; each file meets one."""
        n = min(MOST_PIECES, -(-total // PIECE_BYTES))
        if n <= 1:
            return [F.lit(True)]
        ranges = heads.select(*FILE_KEY, "own_bytes").repartitionByRange(16 * n, *FILE_KEY).groupBy(F.spark_partition_id().alias("i")).agg(F.min(F.struct(*FILE_KEY)).alias("low"), F.sum("own_bytes").alias("bytes"))
        cuts, held = [], 0
        for r in sorted(ranges.collect(), key=lambda r: r["i"]):
            if held >= (len(cuts) + 1) * total / n:
                cuts.append(r["low"])
            held += r["bytes"]
        past = [F.struct(*FILE_KEY) >= F.struct(*(F.lit(c[k]).cast("string").alias(k) for k in FILE_KEY)) for c in cuts]
        number = reduce(add, (F.coalesce(x, F.lit(False)).cast("int") for x in past), F.lit(0))
        return [number == k for k in range(len(cuts) + 1)]

    def _copied(self, source: Store) -> str:
        """A segment with the live rows of a store; they are moved only if several segments hold them."""
        m = source.manifest()
        with tidy(self.spark, source.spark):
            if source._scattered(m) or not source._dead(m)[1]:
                return self._write_segment(source._rows(), None, clustered=True)
            return self._write_segment(Store(in_order(self.spark), source.root, source.registry, m)._rows(), None, arranged=tuple(TABLES))

    def fingerprints(self) -> DataFrame:
        return self.graph().files.select(*FILE_KEY, "fingerprint", "origin")

    def upsert(self, files: DataFrame, reindex: bool = False, stream: tuple[str, int] | None = None) -> DataFrame:
        """Indexes files (org, repo, path, content, ...) and returns an outcome for each input row.

        Of rows with one normalised path the last (by ``seq`` if there is such a column, then by the content's
        hash) wins; the others are "superseded".  Files whose content, language and extractor version are
        unchanged are not parsed, unless ``reindex``.  With ``stream`` = (name, batch), a batch that was
        committed already does nothing.
        """
        m = self.manifest()
        if stream is not None and stream[1] <= m.stream_batches.get(stream[0], -1):
            return self.spark.createDataFrame([], "org string, repo string, path string, status string, replaced boolean, symbols bigint, tokens bigint, note string")
        with tidy(self.spark, files.sparkSession):
            return self._upsert(m, files, reindex, stream)

    def _upsert(self, m: Manifest, files: DataFrame, reindex: bool, stream: tuple[str, int] | None) -> DataFrame:
        known = self.fingerprints().withColumnRenamed("fingerprint", "old").withColumnRenamed("origin", "old_origin")
        rows = files.withColumn("path", C.normalize_path(F.col("path")))
        own = (F.col("seq").cast("bigint") if "seq" in files.columns else F.lit(0).cast("bigint")).alias("own_seq")
        marks = [own, F.sha2("content", 256).alias("own_hash")]
        rows = rows.withColumns({"own_seq": marks[0], "own_hash": marks[1], "own_language": F.lower("language") if "language" in files.columns else F.lit(None).cast("string")})
        # who wins, and who is unchanged, is found on keys and hashes; contents move once, and only those to be parsed
        heads = rows.select(*FILE_KEY, "own_seq", "own_hash", "own_language", F.coalesce(F.octet_length("content"), F.lit(0)).alias("own_bytes"))
        heads = heads.groupBy(*FILE_KEY).agg(F.max(F.struct("own_seq", "own_hash", "own_language", "own_bytes")).alias("top"), F.count(F.lit(1)).alias("copies"))
        heads = heads.select(*FILE_KEY, "top.*", "copies").join(known, FILE_KEY, "left")
        # the cheap test before parsing: same bytes, same language, same extractor version
        old_hash = F.regexp_extract("old", r"^sha256:([0-9a-f]+)\|", 1)
        old_lang = F.regexp_extract("old", r"^sha256:[0-9a-f]+\|([^|]*)\|", 1)
        versions = F.create_map(*(x for k, e in self.registry.by_language.items() for x in (F.lit(k), F.lit(e.version))))
        same = (old_hash == F.col("own_hash")) & (C.fingerprint_version(F.col("old")) == F.coalesce(F.try_element_at(versions, old_lang), F.lit(0))) & (F.col("own_language").isNull() | (F.col("own_language") == old_lang))
        heads = heads.withColumn("same", F.lit(False) if reindex else F.coalesce(same, F.lit(False)))
        staged = f"{self.root}/staging/{uuid.uuid4().hex}-heads"
        heads.write.parquet(staged)
        heads = self.spark.read.parquet(staged)
        unchanged = heads.where("same")
        total = heads.agg(F.count(F.when(F.col("same") | (F.col("copies") > 1), 1)).alias("beaten"), F.count(F.when(~F.col("same"), 1)).alias("files"), F.coalesce(F.sum(F.when(~F.col("same"), F.col("own_bytes"))), F.lit(0)).alias("bytes")).first()
        todo = rows
        if total["beaten"]:
            own = [*FILE_KEY, "own_seq", "own_hash", "own_language"]
            win = heads.where("not same").select(*(F.col(c).alias(f"win_{c}") for c in own), "copies")
            same_row = [rows[c].eqNullSafe(win[f"win_{c}"]) for c in own]
            todo = rows.join(win, reduce(and_, same_row)).select(*rows.columns, "copies")
            once = todo.where("copies = 1")
            todo = once.unionByName(todo.where("copies > 1").dropDuplicates(FILE_KEY)).select(*rows.columns)
        todo = todo.drop("own_seq", "own_hash", "own_language")
        pieces = self._pieces(heads.where("not same"), total["bytes"])
        tasks = max(-(-total["bytes"] // PARSE_BYTES // len(pieces)), min(total["files"], self.spark.sparkContext.defaultParallelism), 1)
        base = f"{self.root}/staging/{uuid.uuid4().hex}"
        segment, ordered = uuid.uuid4().hex, in_order(self.spark)
        for k, piece in enumerate(pieces):  # one after the other, so that what is staged isn't there as a whole beside the segment
            # in order before they are parsed, contents move and nothing that is made of them
            placed = todo.where(piece).repartitionByRange(tasks, *FILE_KEY).sortWithinPartitions(*FILE_KEY)
            _compact(prepare(placed, self.registry, packed=True), "tokens.list.element.").parquet(f"{base}-{k}")
            done = self.spark.read.parquet(f"{base}-{k}")
            numbered = ordered.read.schema(done.schema).parquet(f"{base}-{k}").withColumn("seq", F.lit(m.next_seq).cast("bigint"))
            self._write_tables(segment, segment_rows(numbered), arranged=("tokens",), packed=True)
            # not the tokens: they go before the outcomes are joined
            done.select(*FILE_KEY, "status", F.size("symbols").cast("bigint").alias("symbols"), F.size("tokens").cast("bigint").alias("tokens"), "note").write.mode("append").parquet(f"{base}-counted")
            self._drop(f"{base}-{k}")
        self._write_keys(segment, None)
        m.segments = [*m.segments, segment]
        m.next_seq += 1
        if stream is not None:
            m.stream_batches = m.stream_batches | {stream[0]: stream[1]}
        replaced = known.select(*FILE_KEY, F.lit(True).alias("replaced"))
        out = self.spark.read.parquet(f"{base}-counted").join(replaced, FILE_KEY, "left").select(*FILE_KEY, "status", F.coalesce("replaced", F.lit(False)).alias("replaced"), "symbols", "tokens", "note")
        none = F.lit(None).cast("string").alias("note")
        zero = F.lit(0).cast("bigint")
        beaten = heads.where("copies > 1").select(*FILE_KEY, F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
        for part, status in ((unchanged, "unchanged"), (beaten, "superseded")):
            out = out.unionByName(part.select(*FILE_KEY, F.lit(status).alias("status"), F.lit(False).alias("replaced"), zero.alias("symbols"), zero.alias("tokens"), none))
        out.write.parquet(f"{base}-outcomes")  # before the commit: afterwards everything would be unchanged
        self._commit(m)
        self._drop(f"{base}-counted", staged)
        return self.spark.read.parquet(f"{base}-outcomes")

    def ingest_declared(self, declared: list[dict]) -> DataFrame:
        """Files whose symbols and tokens the caller supplies; spans are checked, nothing is dropped silently."""
        m = self.manifest()
        for d in declared:
            for what in ("org", "repo", "path", "language"):
                if not d[what] or "\0" in d[what]:
                    raise ValueError(f"invalid {what}")
        g = graph_from_declarations(self.spark, declared)
        files = g.files.withColumn("seq", F.lit(m.next_seq).cast("bigint"))
        counters = file_counters(g)
        m.segments = [*m.segments, self._write_segment({"files": files, "symbols": g.symbols, "tokens": g.tokens, "postings": g.postings, "counters": counters}, None)]
        m.next_seq += 1
        self._commit(m)
        return files.select(*FILE_KEY)

    def rebuild(self) -> None:
        """Recomputes postings and counters from the base tables, as one clustered segment."""
        m = self.manifest()
        if m.segments:
            g = self.graph()
            m.segments = [self._write_segment({"files": g.files, "symbols": g.symbols, "tokens": g.tokens, "postings": postings(g), "counters": file_counters(g)}, None, clustered=True)]
            self._commit(m)

    def begin_batch(self) -> None:
        """Marks that a run of several commits is under way."""
        m = self.manifest()
        m.open_batch = True
        self._commit(m)

    def end_batch(self) -> None:
        m = self.manifest()
        m.open_batch = False
        self._commit(m)

    def prune(self, org: str, repo: str, keep: DataFrame, dry_run: bool = False) -> DataFrame:
        """Removes files of a repository that came from a directory and aren't in keep (path); returns their paths."""
        here = self.graph().files.where((F.col("org") == org) & (F.col("repo") == repo) & (F.col("origin") == "directory"))
        kept = keep.select(C.normalize_path(F.col("path")).alias("path"))
        gone = here.join(kept, "path", "left_anti").select(*FILE_KEY)
        return self._remove(gone, dry_run)

    def _remove(self, gone: DataFrame, dry_run: bool) -> DataFrame:
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        gone.write.parquet(path)
        gone = self.spark.read.parquet(path)
        if not dry_run and gone.take(1):
            m = self.manifest()
            m.segments = [*m.segments, self._write_segment(None, gone)]
            self._commit(m)
        return gone.orderBy(*FILE_KEY)

    def delete(self, org: str, repo: str | None = None, dry_run: bool = False) -> DataFrame:
        """Removes an organisation or repository; returns (org, repo, files, symbols, tokens). A missing one is no error."""
        where = F.col("org") == org
        if repo is not None:
            where = where & (F.col("repo") == repo)
        g = self.graph()
        stats = K.describe(g.only(where)).groupBy("org", "repo").agg(*(F.sum(c).alias(c) for c in ("files", "symbols", "tokens")))
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        stats.write.parquet(path)
        self._remove(g.files.where(where).select(*FILE_KEY), dry_run)
        return self.spark.read.parquet(path).orderBy("org", "repo")

    def dead_terms(self) -> DataFrame:
        """Terms of any segment that no live token has."""
        m, every = self.manifest(), None
        for n, name in enumerate(m.segments):
            part = self._part(name, "tokens", m.dropped.get(name)).select(*FILE_KEY, "text", F.lit(n).alias("nth"))
            every = part if every is None else every.union(part)
        if every is None:
            return self.spark.createDataFrame([], "text string")
        # one pass over the tokens, of which only the distinct texts move
        dead, lives = self._dead(m)[0], F.lit(True)
        for i, (rows, by) in enumerate(dead):
            every = every.join(rows.withColumn(f"dead{i}", F.lit(True)), by, "left")
            lives = lives & F.col(f"dead{i}").isNull()
        return every.groupBy("text").agg(F.max(lives).alias("lives")).where("not lives").select("text")

    def vacuum(self, grace: float = SNAPSHOT_SECONDS) -> int:
        """Drops what is dead by compacting; returns the number of dead terms."""
        with tidy(self.spark):
            n = self.dead_terms().count()
        self.compact(grace)
        return n

    def compact(self, grace: float = SNAPSHOT_SECONDS) -> None:
        """Brings the live rows into one segment and deletes what no reader can hold any more.

        If one segment holds them already and what is dead in it is whole repositories, it stays without these: no row
        is moved, so nothing lies beside it. Else the live rows are rewritten. Readers pin a manifest for
        SNAPSHOT_SECONDS at most; manifests older than ``grace`` seconds go, but for the newest, and then segments,
        repositories of segments and staged files that no manifest left names.
        """
        m = self.manifest()
        if m.segments:
            with tidy(self.spark):
                gone = self._droppable(m)
            if gone is None:
                m.segments = [self._copied(self)]
            else:
                m.segments = self._holders(m)
                m.dropped = {s: [*m.dropped.get(s, []), *gone] for s in m.segments}
            self._commit(m)
        self._sweep(grace)

    def _sweep(self, grace: float) -> None:
        fs, p = self._fs(f"{self.root}/manifests")
        old = {int(f.getPath().getName().split(".")[0]): f for f in fs.listStatus(p)} if fs.exists(p) else {}
        now, named = time.time() * 1000, {}  # by segment, the repositories that every manifest leaves out
        for version, f in sorted(old.items()):
            if version < max(old) and now - f.getModificationTime() >= grace * 1000:
                fs.delete(f.getPath(), False)
            else:
                m = self._read_manifest(version)
                for s in m.segments:
                    out = {(org, repo) for org, repo in m.dropped.get(s, [])}
                    named[s] = named[s] & out if s in named else out
        for folder in ("segments", "staging"):
            fs, p = self._fs(f"{self.root}/{folder}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                if f.getPath().getName() not in named and now - f.getModificationTime() >= grace * 1000:
                    fs.delete(f.getPath(), True)
        for s, parts in named.items():
            for table in TABLES:
                self._drop_partitions(f"{self.root}/segments/{s}/{PACKED.get(table, table)}", parts)

    def _drop_partitions(self, path: str, parts: set[tuple[str, str]]) -> None:
        fs, p = self._fs(path)
        jvm = self.spark._jvm
        named = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for org in sorted({o for o, _ in parts}) if parts and fs.exists(p) else []:
            top = jvm.org.apache.hadoop.fs.Path(p, named(PARTS[0], org))
            if fs.exists(top):
                for repo in sorted(r for o, r in parts if o == org):
                    fs.delete(jvm.org.apache.hadoop.fs.Path(top, named(PARTS[1], repo)), True)
                if not fs.listStatus(top):
                    fs.delete(top, False)

    def inconsistent(self) -> DataFrame:
        """(what, side, rows): how the stored postings and counters differ from the base tables; no rows if they agree."""
        g, out = self.graph(), None
        doubtful = self._doubtful(g)
        few = doubtful.limit(MOST_DEAD + 1).count() <= MOST_DEAD
        only = lambda df: df.join(F.broadcast(doubtful) if few else doubtful, FILE_KEY, "left_semi")
        part_of = Graph(only(g.files), g.symbols, only(g.tokens))
        for what, stored, fresh in (("postings", only(g.postings), postings(part_of)), ("counters", self._counters().groupBy(*S.COUNTERS.names[:-1]).agg(F.sum("count").alias("count")), file_counters(g))):
            part = K.differences(stored, fresh.select(*stored.columns)).groupBy("side").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(what).alias("what"), "side", "rows")
            out = part if out is None else out.unionByName(part)
        return out

    def _doubtful(self, g: Graph) -> DataFrame:
        """The keys of the files whose stored postings may differ from their tokens: sums of hashes by file differ.

        Tokens are counted where they lie, so only sums move.  A file that lies in two places comes out doubtful too.
        """
        tokens = Store(in_order(self.spark), self.root, self.registry, self.manifest()).graph().tokens
        key = ", ".join(f"{c} string" for c in FILE_KEY)
        counted = tokens.select(*FILE_KEY, "text").mapInArrow(_count_runs, f"{key}, text string, count bigint")
        both = [F.sum(F.xxhash64("text", "count", F.lit(seed)).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)] + [F.count(F.lit(1)).alias("n")]
        counted = self.spark.read.parquet(self._staged(counted.groupBy(*FILE_KEY).agg(*both)))
        same = ("language", "encoding", "lossy")
        held = g.postings.groupBy(*FILE_KEY).agg(*both, *(f(c).alias(f"{n}_{c}") for c in same for n, f in (("least", F.min), ("most", F.max), ("known", F.count))))
        found = counted.alias("a").join(held.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in FILE_KEY], "full")
        found = found.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in FILE_KEY), reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("s1", "s2", "n"))).alias("sums"), F.col("b.n").alias("n"), *(f"{x}_{c}" for c in same for x in ("least", "most", "known")))
        found = found.join(g.files.select(*FILE_KEY, *same), FILE_KEY, "left")
        agree = [F.col(f"least_{c}").eqNullSafe(F.col(c)) & F.col(f"most_{c}").eqNullSafe(F.col(c)) & (F.col(f"known_{c}") == F.when(F.col(c).isNull(), 0).otherwise(F.col("n"))) for c in same]
        return self.spark.read.parquet(self._staged(found.where(~F.coalesce(reduce(and_, [F.col("sums"), *agree]), F.lit(False))).select(*FILE_KEY)))

    def _drop(self, *paths: str) -> None:
        for path in paths:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def _staged(self, df: DataFrame) -> str:
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def file_tokens(self, org: str, repo: str, path: str, first: int, last: int) -> DataFrame:
        """A file's tokens with ordinals first to last: one partition, and of its files the row groups that hold them."""
        return self.graph().tokens.where((F.col("org") == org) & (F.col("repo") == repo) & (F.col("path") == path) & F.col("ordinal").between(first, last)).orderBy("ordinal")

    def space(self) -> DataFrame:
        """(segment, bytes, live)."""
        fs, p = self._fs(f"{self.root}/segments")
        live = set(self.manifest().segments)
        rows = [(s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength(), s.getPath().getName() in live) for s in fs.listStatus(p)] if fs.exists(p) else []
        return self.spark.createDataFrame(rows, "segment string, bytes long, live boolean")

    def export(self, path: str, compression: str = "none") -> None:
        """One JSON object per node, in pre-order, as text files."""
        from ..operators.tree import pre_order
        from ..plans.graph import nodes

        nodes(self.graph()).orderBy(*pre_order()).select(F.to_json(F.struct("key", "parent", "kind", "name", "start", "end")).alias("value")).write.text(path, compression=compression)

    def export_snapshot(self, root: str) -> Store:
        """A copy of the live rows as a store of its own."""
        other = Store(self.spark, root, self.registry)
        other._commit(Manifest(segments=[other._copied(self)]))
        return other

    def install_snapshot(self, root: str) -> None:
        """Replaces everything by the live rows of another store."""
        other = Store(self.spark, root, self.registry)
        m = self.manifest()
        m.segments = [self._copied(other)]
        m.next_seq = max(m.next_seq, other.manifest().next_seq)
        self._commit(m)

    def snapshot_age(self) -> float | None:
        """Milliseconds since this snapshot was pinned; None for the store itself."""
        return None if self.pinned is None else (time.time() - self.pinned_at) * 1000

    def check_gaps(self, force: bool = False) -> None:
        """Refuses to go on when stored symbols come from languages that no extractor is registered for."""
        gaps = [] if force else [r["language"] for r in self.extractor_gaps().select("language").distinct().limit(50).collect()]
        if gaps:
            raise RuntimeError(f"no extractor for {', '.join(sorted(gaps))}: re-indexing would lose their symbols; force to go on")

    def extractor_gaps(self) -> DataFrame:
        return K.extractor_gaps(self.graph(), sorted(self.registry.by_language))
