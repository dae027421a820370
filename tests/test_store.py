"""The store, the directory source, decoding, streaming and the tools, end to end on small folders."""

import json
import os

import pytest

from arborlex.functions.encoding import decode, is_binary, sniff_utf16
from arborlex.operators.catalog import describe, describe_by_scan, differences
from arborlex.operators.render import as_json, hits_as_text, symbols_as_text
from arborlex.operators.search import Query, SymbolQuery, search, search_symbols
from arborlex.plans.deadline import DeadlineExceeded, collect_within
from arborlex.plans.graph import postings
from arborlex.plans.tools import BadArgument, Tools
from arborlex.sources import walk
from arborlex.sources.store import Conflict, Manifest, Store
from arborlex.streaming.ingest import folder_stream, ingest

SCHEMA = "org string, repo string, path string, content binary, origin string, seq long"


def frame(spark, *files):
    return spark.createDataFrame([(*f[:2], f[2], bytearray(f[3].encode()), "directory", n) for n, f in enumerate(files)], SCHEMA)


def outcomes(df):
    return sorted((r["path"], r["status"]) for r in df.collect())


def test_upsert_prune_delete_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.detect_format() is None and s.graph().files.count() == 0
    py = "class A:\n    def m(self):\n        foo()\n"
    first = s.upsert(frame(spark, ("o", "r", "a.py", py), ("o", "r", "./b.txt", "foo bar"), ("o", "r", "b.txt", "foo baz"), ("o", "", "c.txt", "x")))
    assert outcomes(first) == [("a.py", "ok"), ("b.txt", "ok"), ("b.txt", "superseded"), ("c.txt", "invalid repo")]
    assert [r["symbol"] for r in search(s.graph(), Query("foo", "method")).collect()] == ["A::m", None]
    assert search(s.graph(), Query("bar")).count() == 0 and s.detect_format() == 1
    before = s.snapshot()
    second = s.upsert(frame(spark, ("o", "r", "a.py", py), ("o", "r", "b.txt", "qux")))
    assert outcomes(second) == [("a.py", "unchanged"), ("b.txt", "ok")]
    assert [r["replaced"] for r in second.where("path = 'b.txt'").collect()] == [True]
    assert search(s.graph(), Query("baz")).count() == 0 and search(before.graph(), Query("baz")).count() == 1
    assert sorted(r[0] for r in s.dead_terms().collect()) == ["baz"]
    assert s.vacuum() == 1 and s.dead_terms().count() == 0
    keep = spark.createDataFrame([("a.py",)], "path string")
    assert [r["path"] for r in s.prune("o", "r", keep, dry_run=True).collect()] == ["b.txt"] and s.graph().files.count() == 2
    s.prune("o", "r", keep)
    assert [r["path"] for r in s.graph().files.collect()] == ["a.py"]
    assert [(r["files"], r["symbols"]) for r in s.delete("o").collect()] == [(1, 2)] and s.graph().files.count() == 0
    assert s.delete("none").count() == 0
    with pytest.raises(Conflict):
        s._commit(Manifest(version=s.manifest().version - 1))


def test_reindex_export_and_batches(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.begin_batch()
    assert s.manifest().open_batch
    s.upsert(frame(spark, ("o", "r", "a.go", "package p\nfunc F() {}\n")))
    s.end_batch()
    assert outcomes(s.upsert(frame(spark, ("o", "r", "a.go", "package p\nfunc F() {}\n")), reindex=True)) == [("a.go", "ok")]
    s.export(str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted(os.listdir(tmp_path / "out")) if f.startswith("part") for x in open(tmp_path / "out" / f)]
    assert [x["kind"] for x in lines[:5]] == ["org", "repo", "file", "symbol", "token"] and not s.manifest().open_batch
    copy = s.export_snapshot(str(tmp_path / "copy"))
    third = Store(spark, str(tmp_path / "third"))
    third.upsert(frame(spark, ("x", "y", "old.txt", "old")))
    third.install_snapshot(str(tmp_path / "copy"))
    assert [r["path"] for r in third.graph().files.collect()] == ["a.go"] and third.snapshot_age() is None and third.snapshot().snapshot_age() >= 0
    third.registry.by_language.pop("go")
    with pytest.raises(RuntimeError, match="go"):
        third.check_gaps()
    third.check_gaps(force=True)
    assert copy.graph().tokens.count() == s.graph().tokens.count() and s.space().count() >= 2


def test_walk_and_tools(spark, tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / ".git" / "x").write_text("no")
    (root / ".gitignore").write_text("*.log\n!keep.log\n/build/\n")
    (root / "build").mkdir()
    (root / "build" / "y.py").write_text("x = 1")
    for name, text in (("a.py", "def f():\n    return foo\n"), ("b.log", "x"), ("keep.log", "y"), ("sub/c.go", "package p\n")):
        (root / name).write_text(text)
    os.symlink(root / "a.py", root / "link.py")
    found = {f.path: f.reason for f in walk.walk(str(root))}
    assert found == {".gitignore": None, "a.py": None, "keep.log": None, "link.py": "symlink", "sub/c.go": None}
    tools = Tools(Store(spark, str(tmp_path / "store")))
    stats = {r["status"]: r["files"] for r in tools.index_path(str(root), "o", "r")}
    assert stats == {"ok": 4, "skipped: symlink": 1}
    page = tools.search("foo")
    assert [r["symbol"] for r in page.rows] == ["f"] and not page.has_more
    assert [r["name"] for r in tools.find_symbols("*", limit=1).rows] == ["f"] and tools.find_symbols("*", limit=1).next_offset == 1
    assert [r["path"] for r in tools.list_files("o", "r", "sub/").rows] == ["sub/c.go"]
    assert [r["name"] for r in tools.file_outline("o", "r", "a.py").rows] == ["f"] and tools.list_repos().rows == [{"org": "o", "repo": "r"}]
    assert len(tools.file_tokens("o", "r", "a.py", 2, 2).rows) == 2 and tools.describe()[0]["files"] == 4
    with pytest.raises(BadArgument):
        tools.search("", "file")
    with pytest.raises(BadArgument):
        tools.find_symbols("*g*")
    with pytest.raises(BadArgument, match="python"):
        tools.find_symbols("*", language="pyhton")
    (root / "a.py").unlink()
    assert tools.prune(str(root), "o", "r") == ["a.py"] and search_symbols(tools.graph, SymbolQuery("f")).count() == 0


def test_encoding_rules():
    rules = walk.encoding_rules('[encoding]\n"legacy/*.txt" = "shift_jis"\n"*.bin" = "auto"\n')
    assert walk.encoding_of("legacy/a.txt", rules) == "shift_jis" and walk.encoding_of("x/a.bin", rules) is None


def test_decoding():
    assert decode("é".encode()) == ("é", "UTF-8", False)
    assert decode(b"\xff\xfea\x00") == ("a", "UTF-16LE", False) and decode(b"\xfe\xff\x00a") == ("a", "UTF-16BE", False)
    assert sniff_utf16("hello there".encode("utf-16-le")) == "UTF-16LE" and decode(b"caf\xe9")[:2] == ("café", "windows-1252")
    assert decode("日本".encode("shift_jis"), "shift_jis") == ("日本", "Shift_JIS", False) and decode("日".encode("iso2022_jp")).encoding == "ISO-2022-JP"
    assert is_binary(b"a\0b") and not is_binary("ab".encode("utf-16")) and decode(b"\xff", "utf-8").lossy
    with pytest.raises(ValueError):
        decode(b"x", "no-such")


def test_stream_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("foo")
    s = Store(spark, str(tmp_path / "store"))
    ingest(folder_stream(spark, str(src), "o", "r"), s, "files", str(tmp_path / "ck")).awaitTermination()
    assert [r["path"] for r in s.graph().files.collect()] == ["a.txt"] and search(s.graph(), Query("foo")).count() == 1
    version = s.manifest().version
    assert s.upsert(frame(spark, ("o", "r", "z.txt", "x")), stream=("files", 0)).count() == 0 and s.manifest().version == version
    (src / "b.txt").write_text("foo bar")
    ingest(folder_stream(spark, str(src), "o", "r"), s, "files", str(tmp_path / "ck")).awaitTermination()
    assert search(s.graph(), Query("foo")).count() == 2 and s.manifest().stream_batches == {"files": 1}


def test_declared_files_and_rebuild(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    token = {"text": "foo", "class": "identifier", "start": 0, "end": 3, "start_line": 1, "start_col": 1, "end_line": 1, "end_col": 4}
    s.ingest_declared([{"org": "o", "repo": "r", "path": "a.zig", "language": "zig", "symbols": [], "tokens": [token, {**token, "start": 4, "end": 7}]}])
    before = [(r["file"], r["count"]) for r in search(s.graph(), Query("foo", "file")).collect()]
    s.rebuild()
    assert before == [("a.zig", 2)] == [(r["file"], r["count"]) for r in search(s.graph(), Query("foo", "file")).collect()]
    assert [(r["files"], r["tokens"]) for r in describe(s.graph()).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        s.ingest_declared([{"org": "", "repo": "r", "path": "a", "language": "zig", "symbols": [], "tokens": []}])


def test_stored_counters_equal_a_scan(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, ("o", "r", "a.py", "class A:\n    x = 1\n"), ("o", "r", "b.go", "package p\nfunc F() {}\n"), ("o", "q", "c.txt", "a b")))
    s.upsert(frame(spark, ("o", "r", "a.py", "def f():\n    return 2\n")))
    g = s.graph()
    assert describe(g).collect() == describe_by_scan(g).collect()
    assert differences(g.postings, postings(g)).count() == 0


def test_partitions_dead_segments_and_consistency(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, ("o", "r", "a.py", "x = 1\n"), ("o", "q", "b.txt", "a b"), ("p", "r", "c.txt", "c d e")))
    s.upsert(frame(spark, ("o", "r", "a.py", "y = 2\n")))
    plan = s.graph().tokens.where("org = 'p'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(org" in plan
    assert s.inconsistent().count() == 0
    held = {r["segment"] for r in s.space().collect()}
    pinned = s.snapshot()
    s.compact()
    assert held < {r["segment"] for r in s.space().collect()} and pinned.graph().files.count() == 3
    s.vacuum(grace=0)
    assert [r["live"] for r in s.space().collect()] == [True] and s.graph().files.count() == 3 and s.dead_terms().count() == 0
    assert [r["text"] for r in s.file_tokens("p", "r", "c.txt", 1, 2).collect()] == ["d", "e"]


def test_upsert_takes_the_last_of_repeated_rows(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    rows = [("o", "r", "x.txt", b"one", 1), ("o", "r", "./x.txt", b"two", 3), ("o", "r", "x.txt", b"two", 3), ("o", "r", "x.txt", b"three", 2)]
    out = s.upsert(spark.createDataFrame(rows, "org string, repo string, path string, content binary, seq long"))
    assert sorted(r["status"] for r in out.collect()) == ["ok", "superseded", "superseded", "superseded"]
    assert [r["text"] for r in s.graph().tokens.collect()] == ["two"]


def test_renderers_and_deadline(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, ("o", "r", "a.py", "class A:\n    def m(self):\n        foo()\n")))
    g = s.graph()
    assert [r[0] for r in hits_as_text(search(g, Query("foo", "method"))).collect()] == ["o/r/a.py:2:5-3:14  A::m  method  x1"]
    assert [r[0] for r in symbols_as_text(search_symbols(g, SymbolQuery("A"))).collect()] == ["o/r/a.py:1:7  A  type/class"]
    assert json.loads(as_json(search(g, Query("foo", "repo"))).first()[0])["count"] == 1
    assert len(collect_within(spark, 60, lambda: g.files)) == 1
    with pytest.raises(DeadlineExceeded):
        slow = spark.range(0, 1_000_000, 1, 100_000).selectExpr("sum(id)")  # many short tasks: cancelling stops between them
        collect_within(spark, 1.0, lambda: slow)


def _tree_bytes(folder):
    return {os.path.relpath(os.path.join(a, f), folder): os.path.getsize(os.path.join(a, f)) for a, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_tokens_are_packed_and_unpacked_alike(spark):
    from arborlex import schema as S
    from arborlex.sources.store import pack, unpack

    rows = [("o", "r", "a", 0, "äb", "identifier", None, 4, 7, 1, 5, 1, 7, "x"), ("o", "r", "a", 1, "/*\n*/", "comment", 2, 9, 14, 1, 9, 2, 3, "x"), ("o", "r", "b", 0, None, None, None, *[None] * 6, "x")]
    tokens = spark.createDataFrame(rows, S.TOKENS)
    assert unpack(pack(tokens)).select(*S.TOKENS.names).collect() == tokens.collect()
    assert [tuple(r) for r in pack(tokens).select("end", "end_line", "start_col", "end_col").collect()][0] == (0, 0, 1, 0)


def test_upsert_leaves_no_staged_tokens_and_no_unsorted_file(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    words = " ".join(f"w{n % 50}" for n in range(3000))
    s.upsert(frame(spark, *(("o", f"r{n % 3}", f"{n:03d}.txt", words) for n in range(30))))
    sizes = _tree_bytes(tmp_path / "store")
    staged = sum(v for k, v in sizes.items() if k.startswith("staging"))
    tokens = sum(v for k, v in sizes.items() if "/packed/" in k)
    assert s.graph().tokens.count() == 90_000 and tokens < 4 * 90_000 and staged < tokens
    for k in sizes:
        if "/packed/" in k:
            rows = spark.read.parquet(str(tmp_path / "store" / k)).select("path", "ordinal").collect()
            assert rows == sorted(rows)
    assert s.inconsistent().count() == 0
    before = {tuple(r) for r in s.graph().tokens.collect()}
    s.delete("o", "r0")
    s.compact()
    assert {tuple(r) for r in s.graph().tokens.collect()} == {r for r in before if r[1] != "r0"}


def test_upsert_gives_every_row_an_outcome(spark, tmp_path):
    """A null content is an empty file, also where other rows are beaten."""
    s = Store(spark, str(tmp_path / "store"))
    rows = [("o", "r", "a.txt", None, 1), ("o", "r", "b.txt", b"x", 1), ("o", "r", "b.txt", b"y", 2), (None, "r", "c.txt", b"z", 1)]
    out = s.upsert(spark.createDataFrame(rows, "org string, repo string, path string, content binary, seq long"))
    assert sorted(r["status"] for r in out.collect()) == ["invalid org", "ok", "ok", "superseded"]


def test_consistency_moves_sums_and_finds_every_difference(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, ("o", "r", "a.txt", "x x y"), ("o", "r", "b.txt", "x z"), ("o", "q", "c.txt", "y")))
    assert s._doubtful(s.graph()).count() == 0 and s.inconsistent().count() == 0
    rows = s._rows()
    wrong = rows["postings"].where("path <> 'c.txt'").selectExpr(*(c if c != "count" else "if(text = 'z', 2, count) as count" for c in rows["postings"].columns))
    again = wrong.where("text = 'y'")  # a row too many, whose sum over tokens would be the same if counts were split
    m = s.manifest()
    m.segments = [s._write_segment(rows | {"postings": wrong.unionByName(again)}, None)]
    s._commit(m)
    assert sorted(r["path"] for r in s._doubtful(s.graph()).collect()) == ["a.txt", "b.txt", "c.txt"]
    assert sorted(tuple(r) for r in s.inconsistent().collect()) == [("postings", "left", 2), ("postings", "right", 2)]


def test_rows_stay_where_they_are_when_few_files_are_dead(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, ("o", "r", "a.txt", "x y"), ("p", "r", "b.txt", "z")))
    s.delete("o")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = s.graph().tokens._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r["text"] for r in s.graph().tokens.collect()] == ["z"]


def test_compressed_export(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, ("o", "r", "a.txt", "x y")))
    s.export(str(tmp_path / "out"), compression="gzip")
    assert all(f.endswith(".gz") for f in os.listdir(tmp_path / "out") if f.startswith("part"))
    assert [json.loads(r[0])["kind"] for r in spark.read.text(str(tmp_path / "out")).collect()].count("token") == 2


def test_upsert_in_pieces_stages_one_at_a_time(spark, tmp_path, monkeypatch):
    from arborlex.sources import store as module

    monkeypatch.setattr(module, "PIECE_BYTES", 20_000)
    held, drop = [], Store._drop

    def watched(self, *paths):
        sizes = _tree_bytes(tmp_path / "store")
        held.append({k.split("/")[1] for k in sizes if k.startswith("staging") and not k.split("/")[1].endswith(("heads", "counted", "outcomes"))})
        drop(self, *paths)

    monkeypatch.setattr(Store, "_drop", watched)
    s = Store(spark, str(tmp_path / "store"))
    rows = [("o", f"r{n % 3}", f"{n:03d}.txt", f"w{n} " * 800) for n in range(40)]
    out = s.upsert(frame(spark, *rows, ("", "r", "x.txt", "x"), ("o", "r0", "000.txt", "last")))
    assert sorted(r["status"] for r in out.collect()) == ["invalid org"] + ["ok"] * 40 + ["superseded"]
    assert len(held) > 4 and all(len(x) == 1 for x in held[:-1]) and not held[-1]
    assert s.graph().tokens.count() == 39 * 800 + 1 and s.graph().files.count() == 40 and s.space().count() == 1
    assert s.inconsistent().count() == 0 and not s._scattered(s.manifest())


def test_whole_repositories_die_without_a_list_of_their_files(spark, tmp_path, monkeypatch):
    from arborlex.sources import store as module

    monkeypatch.setattr(module, "MOST_DEAD", 2)  # more files die, but for one they are a repository's
    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, *(("o", "r", f"{n}.txt", "x y") for n in range(9)), ("p", "r", "b.txt", "z"), ("p", "r", "c.txt", "z w")))
    s.delete("o")
    s.upsert(frame(spark, ("p", "r", "c.txt", "v")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = s.graph().tokens._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["text"] for r in s.graph().tokens.collect()) == ["v", "z"]
    s.upsert(frame(spark, ("o", "r", "1.txt", "back")))
    assert s.vacuum(grace=0) == 3 and sorted(r["text"] for r in s.graph().tokens.collect()) == ["back", "v", "z"]


def test_sorted_texts_of_postings_are_stored_as_differences(spark, tmp_path):
    import pyarrow.parquet as pq

    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, ("o", "r", "a.txt", " ".join(f"word{n}" for n in range(500)))))
    found = [tmp_path / "store" / k for k in _tree_bytes(tmp_path / "store") if "/postings/" in k]
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(0) for f in found]
    assert [(c.path_in_schema, c.encodings) for c in columns] == [("text", ("DELTA_BYTE_ARRAY",))]
    assert [r["count"] for r in search(s.graph(), Query("word77", "file")).collect()] == [1]


def test_packed_starts_rise_from_file_to_file(spark, tmp_path):
    from arborlex.sources.store import _implied, pack, unpack

    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, *(("o", "r", f"{n}.txt", "one two\nthree é four\n" * 30) for n in range(6))))
    tokens = s.graph().tokens.orderBy("path", "ordinal")
    starts = [r["start"] for r in pack(tokens).orderBy("path", "ordinal").collect()]
    falls = [b - a for a, b in zip(starts, starts[1:], strict=False) if b < a]
    assert len(starts) == 6 * 150 and min(falls) > -10  # a fall of a file's length would widen a whole block of deltas
    assert sorted(unpack(pack(tokens)).collect()) == sorted(tokens.collect())
    # a segment as earlier versions wrote it
    before, m = sorted(tokens.collect()), s.manifest()
    base = tmp_path / "store" / "segments" / m.segments[0]
    tokens.withColumns({c: tokens[c] - x for c, x in _implied().items()}).write.partitionBy("org", "repo").parquet(str(base / "packed"))
    (base / "strided").rename(tmp_path / "away")
    assert sorted(s.graph().tokens.collect()) == before


def test_an_upsert_leaves_no_shuffle_files(spark, tmp_path):
    import time

    from arborlex.sources.store import TIDY

    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(n).getName() for n in range(found.size()) if found.apply(n).getName().startswith("shuffle")}

    before, conf = shuffled(), spark.conf.get(TIDY, None)
    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, *(("o", "r", f"{n}.txt", "x y z") for n in range(20))))
    until = time.time() + 10  # they go in the background
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(TIDY, None) == conf


def test_dead_repositories_go_without_a_copy_of_the_rest(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    odd = "a/b=c %d:é"
    rows = [(odd, "r", "a.txt", "x y"), (odd, "r r", "b.txt", "x k"), ("p", odd, "c.txt", "y w"), ("p", "q", "d.txt", "z"), ("p", "r", "e.txt", "v v")]
    s.upsert(frame(spark, *rows))
    before, held = _tree_bytes(tmp_path / "store" / "segments"), s.manifest().segments
    s.delete(odd)
    s.delete("p", "q")
    pinned = s.snapshot()
    assert s.vacuum() == 3 and s.manifest().segments == held  # the snapshot may still hold what is dead
    assert pinned.graph().files.count() == 2 and Store(spark, s.root, pinned=s._read_manifest(1)).graph().tokens.count() == 9
    plan = s.graph().tokens._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [NOT" in plan and s.graph().tokens.count() == 4 and s.dead_terms().count() == 0
    s.compact(grace=0)
    after = _tree_bytes(tmp_path / "store" / "segments")
    assert set(after) < set(before) and {os.path.dirname(k).split("/")[-2] for k in after if "=" in k} == {"org=p"}
    assert len([k for k in before if "=" in k]) - len([k for k in after if "=" in k]) > 8 and not any("org=a" in d for d, _, _ in os.walk(tmp_path))
    assert [r["live"] for r in s.space().collect()] == [True] and s.inconsistent().count() == 0
    assert sorted((r["org"], r["repo"], r["text"]) for r in s.graph().tokens.collect()) == [("p", odd, "w"), ("p", odd, "y"), ("p", "r", "v"), ("p", "r", "v")]
    # a repository that comes back, and goes again
    s.upsert(frame(spark, rows[0], ("p", "r", "e.txt", "u")))
    assert sorted(r["text"] for r in s.graph().tokens.collect()) == ["u", "w", "x", "y", "y"] and s.graph().files.count() == 3
    copy = s.export_snapshot(str(tmp_path / "copy"))
    assert s.vacuum(grace=0) == 1 and not s.manifest().dropped and s.space().count() == 1
    for x in (s, copy):
        assert sorted(r["text"] for r in x.graph().tokens.collect()) == ["u", "w", "x", "y", "y"] and x.inconsistent().count() == 0


def test_all_repositories_may_go(spark, tmp_path, monkeypatch):
    from arborlex.sources import store as module

    s = Store(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, ("o", "r", "a.txt", "x y"), ("o", "q", "b.txt", "z"), ("p", "r", "c.txt", "z")))
    monkeypatch.setattr(module, "MOST_DROPPED", 1)  # more are rewritten
    held = s.manifest().segments
    s.delete("o")
    assert s.vacuum(grace=0) == 2 and s.manifest().segments != held and not s.manifest().dropped
    s.delete("p")
    assert s.vacuum(grace=0) == 1 and s.graph().tokens.count() == 0 and s.graph().files.count() == 0 and s.dead_terms().count() == 0
    assert s.vacuum(grace=0) == 0 and s.inconsistent().count() == 0
    s.upsert(frame(spark, ("p", "r", "c.txt", "back")))
    assert [r["text"] for r in s.graph().tokens.collect()] == ["back"] and s.inconsistent().count() == 0
