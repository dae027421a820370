"""Files to graph: decode, detect, fingerprint, extract, check, arrange; one row in, one row out, no shuffle."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C
from ..functions.encoding import decode, hint_from_label, is_binary
from ..functions.extract import Registry
from ..functions.languages import default_registry
from ..functions.lexer import Token
from .graph import FILE_KEY, Graph, SpanError, arrange, check_nesting, enclosing

#: Larger files are skipped.
MOST_BYTES = 64 << 20
_ITEM = [("start", "bigint"), ("end", "bigint"), ("start_line", "bigint"), ("start_col", "bigint"), ("end_line", "bigint"), ("end_col", "bigint")]
_SYM = [("sidx", "int"), ("name", "string"), ("kind", "string"), ("lang_kind", "string"), ("owner", "string"), ("qualified", "string"), ("parent_sidx", "int"), ("depth", "int"), ("chain", S.CHAIN), *_ITEM, ("first_tok", "int"), ("last_tok", "int")]
_TOK = [("ordinal", "int"), ("text", "string"), ("class", "string"), ("parent_sidx", "int"), *_ITEM]
_struct = lambda fields: "struct<" + ",".join(f"`{n}`:{t}" for n, t in fields) + ">"
PREPARED = f"org string, repo string, path string, language string, has_errors boolean, origin string, fingerprint string, encoding string, lossy boolean, n_bytes bigint, status string, note string, symbols array<{_struct(_SYM)}>, tokens array<{_struct(_TOK)}>, postings array<struct<text:string,count:bigint>>, counters array<struct<what:string,label:string,count:bigint>>"
INPUT = ("org", "repo", "path", "content", "language", "origin", "encoding", "strict")


def _detect(path: str, text: str, registry: Registry) -> str:
    """The language of a file; the same rules as the column expression."""
    name = re.split(r"[/\\]", path)[-1]
    if name.lower() in ("makefile", "gnumakefile"):
        return "make"
    if name.lower() == "dockerfile":
        return "dockerfile"
    m = re.fullmatch(r".+\.([^.]*)", name)
    ext = m[1].lower() if m else ""
    if ext:
        return registry.claimed().get(ext) or C.EXTENSIONS.get(ext) or ext
    first = text.lstrip("﻿").split("\n", 1)[0]
    if not first.startswith("#!"):
        return "unknown"
    words = first[2:].split()
    program = words[0].rsplit("/", 1)[-1] if words else ""
    if program == "env":
        program = next((w for w in words[1:] if not w.startswith("-")), "")
    program = program.rstrip("0123456789.")
    return C.INTERPRETERS.get(program) or program.lower() or "unknown"


def prepare_one(row: dict, registry: Registry) -> dict:
    """The outcome for one file: status ok, or the reason why it was refused."""
    out = dict.fromkeys(("language", "has_errors", "fingerprint", "encoding", "lossy", "note")) | {k: row[k] for k in ("org", "repo", "path")}
    out |= {"origin": row.get("origin"), "n_bytes": len(row["content"] or b""), "status": "ok", "symbols": [], "tokens": [], "parents": [], "postings": [], "counters": []}
    data = row["content"] or b""
    for what in ("org", "repo", "path"):
        if not row[what] or "\0" in row[what]:
            return out | {"status": f"invalid {what}"}
    if row.get("language") is not None and (not row["language"] or "\0" in row["language"]):
        return out | {"status": "invalid language"}
    if len(data) > MOST_BYTES:
        return out | {"status": "too large"}
    try:
        hint = hint_from_label(row["encoding"]) if row.get("encoding") else None
    except ValueError as e:
        return out | {"status": "unknown encoding", "note": str(e)}
    if is_binary(data, row.get("encoding")):
        return out | {"status": "binary"}
    text, encoding, lossy = decode(data, hint)
    if row.get("strict") and (lossy or encoding != "UTF-8" and not hint):
        return out | {"status": "not UTF-8" if encoding != "UTF-8" else "lossy"}
    language = (row.get("language") or _detect(row["path"], text, registry)).lower()
    found = registry.get(language).run(text)
    tokens, symbols, note = sorted(found.tokens, key=lambda t: t.start), found.symbols, found.note
    try:
        if symbols:  # a lexer's own tokens follow each other
            check_nesting(symbols, ({"start": t.start, "end": t.end} for t in tokens))
    except SpanError as err:
        symbols, note = [], f"symbols dropped: {err}"
    symbols, _ = arrange(symbols, [])
    parents = enclosing(symbols, [t.start for t in tokens]) if symbols else [None] * len(tokens)
    print_ = f"sha256:{hashlib.sha256(data).hexdigest()}|{language}|{registry.version(language)}|1"
    if encoding != "UTF-8" or lossy:
        print_ += f"|enc={encoding}{'+lossy' if lossy else ''}@1"
    out |= {"language": language, "has_errors": found.has_errors, "fingerprint": print_, "encoding": encoding, "lossy": lossy, "note": note, "symbols": symbols, "tokens": tokens, "parents": parents}
    return out | derived(symbols, tokens, encoding, lossy)


def derived(symbols: list[dict], tokens: list[dict], encoding: str, lossy: bool) -> dict:
    """A file's postings and counters; made where the file is parsed, so that no shuffle is needed for them."""
    label = lambda s: s["kind"] if s["lang_kind"] in (None, s["kind"]) else f"{s['kind']}/{s['lang_kind']}"
    counted = [("files", {"": 1}), ("symbol_kind", Counter(map(label, symbols))), ("token_class", Counter(t.cls for t in tokens))]
    counted += [("encoding", {encoding: 1})] * (encoding != "UTF-8") + [("lossy", {"": 1})] * bool(lossy)
    return {"postings": [{"text": t, "count": n} for t, n in sorted(Counter(t.text for t in tokens).items())], "counters": [{"what": w, "label": k, "count": n} for w, c in counted for k, n in sorted(c.items())]}


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt over all cores if their source has fewer splits than that; lexing costs far more than moving a text.

    A large source has more splits than cores and stays as it is.  For plain scans only: to count the splits of
    anything with a shuffle in it, Spark runs that shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def prepare(files: DataFrame, registry: Registry | None = None, packed: bool = False) -> DataFrame:
    """One row of PREPARED for each of files: org, repo, path, content (binary), and optionally language, origin, encoding, strict.

    ``packed``: tokens as the store keeps them (``sources.store.pack``).
    """
    registry = registry or default_registry()
    kinds = {"content": "binary", "strict": "boolean"}
    rows = files.select(*((F.col(c) if c in files.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in INPUT))
    rows = rows.withColumn("path", C.normalize_path(F.col("path")))
    target = T.StructType.fromDDL(PREPARED)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, FILES_AT_ONCE):
                yield _batch([prepare_one(r, registry) for r in batch.slice(i, FILES_AT_ONCE).to_pylist()], arrow, packed)

    return rows.mapInArrow(run, target)


#: Files whose outcomes make one Arrow batch.
FILES_AT_ONCE = 64


def _lists(per_file: list[list], kind: pa.DataType, columns: list[list]) -> pa.Array:
    """A list array, one list of structs a file, from the structs' columns."""
    offsets = pa.array([0, *accumulate(map(len, per_file))], pa.int32())
    struct = kind.value_type
    fields = [struct.field(i) for i in range(struct.num_fields)]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, fields=fields), type=kind)


def _packed(columns: dict[str, list]) -> dict[str, pa.Array]:
    """The span columns as ``sources.store.pack`` makes them."""
    x = {c: pa.array(columns[c], pa.int64()) for c in S.SPAN}
    text = pa.array(columns["text"], pa.string())
    implied = {"end": pc.add(x["start"], pc.cast(pc.binary_length(text), pa.int64())), "end_line": x["start_line"], "start_col": x["start"], "end_col": pc.add(x["start_col"], pc.cast(pc.utf8_length(text), pa.int64()))}
    out = {c: pc.subtract(x[c], y) for c, y in implied.items()}
    stride = pc.multiply(pa.array(columns["ordinal"], pa.int64()), S.STRIDE)
    return out | {"start": pc.subtract(x["start"], stride), "start_col": pc.subtract(pc.subtract(2, out["start_col"]), stride)}


def _batch(done: list[dict], schema: pa.Schema, packed: bool) -> pa.RecordBatch:
    """The outcomes column by column: most of the data is tokens, which never become dictionaries."""
    tokens = [d["tokens"] for d in done]
    columns = [list(c) for c in zip(*(t for own in tokens for t in own), strict=True)] or [[] for _ in Token._fields]
    named = dict(zip(Token._fields, columns, strict=True))
    named |= {"class": named["cls"], "ordinal": [n for own in tokens for n in range(len(own))], "parent_sidx": [p for d in done for p in d["parents"]]}
    if packed:
        named |= _packed(named)
    arrays = []
    for f in schema:
        if f.name == "tokens":
            arrays.append(_lists(tokens, f.type, [named[n] for n, _ in _TOK]))
        elif f.name in ("postings", "counters"):
            own = [d[f.name] for d in done]
            names = [f.type.value_type.field(i).name for i in range(f.type.value_type.num_fields)]
            arrays.append(_lists(own, f.type, [[x[n] for o in own for x in o] for n in names]))
        else:
            arrays.append(pa.array([d[f.name] for d in done], f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def graph_of(prepared: DataFrame) -> Graph:
    """The graph of the prepared rows whose status is ok; write ``prepared`` first if it is costly."""
    ok = prepared.where("status = 'ok'")
    files = ok.select(*FILE_KEY, "language", "has_errors", "origin", "fingerprint", "encoding", "lossy", "n_bytes", (F.xxhash64("org", "repo", "path") * 0).alias("seq"))
    if "seq" in prepared.columns:
        files = ok.select(*FILE_KEY, "language", "has_errors", "origin", "fingerprint", "encoding", "lossy", "n_bytes", "seq")
    syms = ok.select(*FILE_KEY, "language", F.explode("symbols").alias("s")).select(*FILE_KEY, "s.*", "language")
    syms = syms.withColumns({"name_fold": C.ascii_fold(F.col("name")), "dir": C.directory(F.col("path"))}).select(*S.SYMBOLS.names)
    toks = ok.select(*FILE_KEY, "language", F.explode("tokens").alias("t")).select(*FILE_KEY, "t.*", "language").select(*S.TOKENS.names)
    coded = ok.select(*FILE_KEY, "language", "encoding", "lossy", F.explode("postings").alias("p")).select("p.text", *FILE_KEY, "language", "encoding", "lossy", "p.count")
    return Graph(files, syms, toks, coded.select(*S.POSTINGS.names), counters_of(ok.select(*FILE_KEY, "language", F.explode("counters").alias("c")).select(*FILE_KEY, "language", "c.*")))


def counters_of(rows: DataFrame) -> DataFrame:
    """The catalog from counters by file."""
    return rows.groupBy("org", "repo", "language", "what", "label").agg(F.sum("count").alias("count"))


def graph_from_declarations(spark, declared: list[dict]) -> Graph:
    """A graph from caller-supplied files: org, repo, path, language, symbols, tokens (dicts), checked as they are."""
    files, symbols, tokens = [], [], []
    for n, f in enumerate(declared):
        check_nesting(f["symbols"], f["tokens"])
        key = {"org": f["org"], "repo": f["repo"], "path": f["path"]}
        syms, toks = arrange(f["symbols"], f["tokens"])
        more = {"language": f["language"].lower()}
        files.append(key | more | {"has_errors": f.get("has_errors", False), "origin": f.get("origin"), "fingerprint": None, "encoding": "UTF-8", "lossy": False, "n_bytes": None, "seq": n})
        fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        symbols += [key | more | s | {"name_fold": s["name"].translate(fold), "dir": f["path"].rpartition("/")[0]} for s in syms]
        tokens += [key | more | t for t in toks]
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
    chains = [s | {"chain": [tuple(c[k] for k in ("sidx", "name", "kind", "lang_kind", "owner")) for c in s["chain"]]} for s in symbols]
    return Graph(frame(files, S.FILES), frame(chains, S.SYMBOLS), frame(tokens, S.TOKENS)).with_derived()
