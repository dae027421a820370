"""Directories as files to index, with the reasons for what is skipped.

The listing is the driver's (it follows .gitignore files, which need the tree);
contents are read by the executors, which need to see the folder.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.build import MOST_BYTES

CONFIG = ".arborlex.toml"


def _pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """A line of an ignore file as (pattern over the path below the file's folder, negated, folders only)."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[negated:].removeprefix("\\")
    folders = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    return re.compile(("" if anchored else "(?:.*/)?") + _glob(body.lstrip("/")) + r"\Z", re.S), negated, folders


def _glob(body: str) -> str:
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass(frozen=True)
class Found:
    path: str  # below the root, with slashes
    full: str
    reason: str | None  # why it is skipped


def walk(root: str) -> Iterator[Found]:
    """Files below root in path order; a folder's .gitignore holds for all below it; .git is never entered."""

    def ignored(rel: str, is_dir: bool, rules: list) -> bool:
        state = False
        for base, lines in rules:
            below = rel[len(base) :]
            for pattern, negated, folders in lines:
                if (is_dir or not folders) and pattern.match(below):
                    state = not negated
        return state

    def visit(folder: str, rel: str, rules: list) -> Iterator[Found]:
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            yield Found(rel.rstrip("/"), folder, "unreadable")
            return
        own = os.path.join(folder, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                rules = [*rules, (rel, [p for p in map(_pattern, f) if p])]
        for name in names:
            full, path = os.path.join(folder, name), rel + name
            if name == ".git":
                continue
            try:
                path.encode("utf-8")
            except UnicodeEncodeError:
                yield Found(path.encode("utf-8", "replace").decode(), full, "path is not UTF-8")
                continue
            if os.path.islink(full):
                yield Found(path, full, "symlink")
            elif os.path.isdir(full):
                if not ignored(path, True, rules):
                    yield from visit(full, path + "/", rules)
            elif ignored(path, False, rules):
                continue
            elif "\\" in name:
                yield Found(path, full, "backslash in name")
            elif not os.path.isfile(full):
                yield Found(path, full, "not a regular file")
            elif not os.access(full, os.R_OK):
                yield Found(path, full, "unreadable")
            elif os.path.getsize(full) > MOST_BYTES:
                yield Found(path, full, "too large")
            else:
                yield Found(path, full, None)

    yield from visit(root.rstrip("/"), "", [])


def encoding_rules(text: str) -> list[tuple[re.Pattern, str]]:
    """``"glob" = "label"`` lines of the [encoding] table; the first glob that matches a path wins, ``auto`` names none."""
    section, out = None, []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip() if not line.strip().startswith('"') else line.strip()
        if line.startswith("["):
            section = line.strip("[]").strip()
        elif section == "encoding" and (m := re.fullmatch(r'"([^"]+)"\s*=\s*"([^"]*)"\s*(?:#.*)?', line)):
            out.append((re.compile(("" if "/" in m[1] else "(?:.*/)?") + _glob(m[1].lstrip("/")) + r"\Z"), m[2]))
    return out


def encoding_of(path: str, rules: list[tuple[re.Pattern, str]]) -> str | None:
    label = next((label for pattern, label in rules if pattern.match(path)), "auto")
    return None if label == "auto" else label


READ_BYTES = 8 << 20


def _open(batches):
    """Adds the contents of the listed files, some megabytes at a time."""
    import pyarrow as pa

    for batch in batches:
        begin, contents, held = 0, [], 0
        names = batch.column("full").to_pylist()
        for i, name in enumerate(names):
            with open(name, "rb") as f:
                contents.append(f.read())
            held += len(contents[-1])
            if held >= READ_BYTES or i + 1 == len(names):
                piece = batch.slice(begin, len(contents))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(contents, pa.binary())], names=["rel", "full", "encoding", "content"])
                begin, contents, held = i + 1, [], 0


def directory(spark: SparkSession, root: str, org: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """(files to index, skipped files with reasons) of a folder that the executors can read too."""
    found = list(walk(root))
    config = os.path.join(root, CONFIG)
    rules = []
    if os.path.isfile(config):
        with open(config, encoding="utf-8") as f:
            rules = encoding_rules(f.read())
    skipped = spark.createDataFrame([(f.path, f.reason) for f in found if f.reason], "path string, reason string")
    wanted = [(f.path, os.path.abspath(f.full), encoding_of(f.path, rules)) for f in found if not f.reason]
    schema = "org string, repo string, path string, content binary, origin string, encoding string"
    if not wanted:
        return spark.createDataFrame([], schema), skipped
    listed = spark.createDataFrame(wanted, "rel string, full string, encoding string")
    # wanted files only are opened: what is ignored or too large is never read
    files = listed.mapInArrow(_open, "rel string, full string, encoding string, content binary")
    return files.select(F.lit(org).alias("org"), F.lit(repo).alias("repo"), F.col("rel").alias("path"), "content", F.lit("directory").alias("origin"), "encoding"), skipped


def single_file(spark: SparkSession, path: str, org: str, repo: str, language: str | None = None) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.lit(org).alias("org"), F.lit(repo).alias("repo"), F.element_at(F.split("path", "/"), -1).alias("path"), "content", F.lit(language).alias("language"), F.lit("file").alias("origin"))


def tally(outcomes: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(status, files) of an index run."""
    out = outcomes.groupBy("status").count()
    if skipped is not None:
        out = out.unionByName(skipped.groupBy(F.concat(F.lit("skipped: "), "reason").alias("status")).count())
    return out.withColumnRenamed("count", "files").orderBy("status")
