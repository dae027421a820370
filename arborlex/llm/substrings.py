"""Removal of repeated word sequences, found by difference-cover anchors.

A window is ``window`` consecutive words of one document.  A word goes if a
window that covers it also starts in a document with a smaller doc_id.

With the cover {0, 1, 3} modulo 7, any two positions have a shift below 7 that
takes both onto the cover.  So two equal windows of 13 words hold an equal run
of 7 words that starts at a cover position in either document: its hash is the
anchor.  Anchors are hashed at three positions of seven, and one that two
documents share marks the windows around it as candidates.  Candidates only
are extended to whole windows and compared by their words: a window is known
by the BLAKE2b digest (128 bits) of its words joined by one space, so that no
two word sequences that anyone can find are taken for one another.  The
smallest doc_id of each window is found by aggregation; pairs of documents are
never formed.

Documents travel in tiles of some megabytes; a tile sends each distinct anchor
or window once, and each answer is one bit.
"""

from __future__ import annotations

from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .simhash import joined
from .workspace import Workspace, buckets_for

U64 = np.uint64
PERIOD, COVER = 7, (0, 1, 3)
TILE_BYTES = 8 << 20
EACH = 500_000  # entries in a bucket, about
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: no id is larger

TILE = "tile long, doc_ids array<bigint>, lens binary, body binary, n_words long"
ASK = "bucket long, tile long, a binary, b binary, c binary"
_ASK = pa.schema([("bucket", pa.int64()), ("tile", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
PART = "kind string, tile long, part long, a binary, n long"
_PART = pa.schema([("kind", pa.string()), ("tile", pa.int64()), ("part", pa.int64()), ("a", pa.binary()), ("n", pa.int64())])


def _tiles(batches):
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in W.slices(batch, "text", TILE_BYTES):
            data, offsets = W.text_bytes(piece.column("text"))
            n = len(W.word_spans(data, offsets)[0])
            row = {"tile": (part << 32) + k, "doc_ids": piece.column("doc_id").to_pylist(), "lens": W.pack(W.small(np.diff(offsets))), "body": zstandard.ZstdCompressor(level=3).compress(data.tobytes()), "n_words": n}
            k += 1
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("tile", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("body", pa.binary()), ("n_words", pa.int64())]))


def _bucket(h: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    return (h >> U64(bits - (n_buckets.bit_length() - 1))).astype(np.int64) if n_buckets > 1 else np.zeros(len(h), np.int64)


class _Tile:
    def __init__(self, state: dict, window: int):
        self.window, self.span = window, window - PERIOD + 1
        self.doc_ids = state["doc_ids"]
        self.ids = np.array([NO_ID if x is None else x for x in self.doc_ids], np.int64)
        lens = W.unpack(state["lens"]).astype(np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(state["body"]), np.uint8)
        self.offsets = np.cumsum(np.r_[0, lens])
        self.starts, self.ends, self.at = W.word_spans(self.data, self.offsets)

    @cached_property
    def words(self):
        return W.word_hashes(self.data, self.starts, self.ends)

    @cached_property
    def anchors(self):
        """Cover positions, their 48-bit hashes' sorted distinct values, and the index into those."""
        place = np.arange(len(self.words)) - np.repeat(self.at[:-1], np.diff(self.at))
        ok = np.isin(place % PERIOD, COVER) & W.whole_windows(self.at, self.span)
        at = np.flatnonzero(ok)
        h = W.window_hashes(self.words, self.span)[at] >> U64(16) if len(at) else np.zeros(0, U64)
        own, which = np.unique(h, return_inverse=True)
        return at, own, which

    def digests(self, start: np.ndarray) -> np.ndarray:
        """The halves of the digests of the windows that start at these words."""
        text, place = joined(self.data, self.offsets, self.starts, self.ends, self.at)
        s, e, _ = W.word_spans(text, place)
        raw = text.tobytes()
        each = (blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(s[start].tolist(), e[start + self.window - 1].tolist(), strict=True))
        return np.frombuffer(b"".join(each), "<u8").reshape(-1, 2)

    def windows(self, shared: np.ndarray):
        """Starts of candidate windows, the distinct windows (digest halves), the smallest doc_id of each, and the index.

        shared: for each distinct anchor, whether two documents have it.
        """
        at, _, which = self.anchors
        marks = np.zeros(len(self.words) + 1, np.int64)
        marks[at + 1] = shared[which]
        marks = np.cumsum(marks)
        start = np.flatnonzero(W.whole_windows(self.at, self.window))
        start = start[marks[start + PERIOD] > marks[start]]
        if not len(start):
            return start, (np.zeros(0, U64), np.zeros(0, U64)), np.zeros(0, np.int64), start
        one, two = self.digests(start).T
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        first = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return start, (a[first], b[first]), self.least(start, which, len(first)), which

    def least(self, start: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """The smallest doc_id of each of n distinct windows."""
        out = np.full(n, NO_ID)
        np.minimum.at(out, which, self.ids[W.row_of(self.at)[start]])
        return out


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist([dict.fromkeys(schema.names) | r for r in rows], schema=schema)


def _cuts(bucket: np.ndarray):
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True)


def _ask_anchors(window: int, n_buckets: int):
    def run(batches):
        for batch in batches:
            for state in batch.to_pylist():
                t = _Tile(state, window)
                at, own, which = t.anchors
                row = W.row_of(t.at)[at]
                low, high = np.full(len(own), len(t.ids)), np.full(len(own), -1)
                np.minimum.at(low, which, row)
                np.maximum.at(high, which, row)
                for i, j in _cuts(_bucket(own, 48, n_buckets)):
                    b = int(_bucket(own[i : i + 1], 48, n_buckets)[0])
                    yield pa.RecordBatch.from_pylist([{"bucket": b, "tile": state["tile"], "a": W.pack_sorted(own[i:j]), "b": W.pack(np.packbits(low[i:j] < high[i:j])), "c": None}], schema=_ASK)

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    asked = table.to_pylist()
    hashes = [W.unpack_sorted(r["a"]) for r in asked]
    many = np.concatenate([np.unpackbits(W.unpack(r["b"]), count=len(h)) for r, h in zip(asked, hashes, strict=True)])
    own, which = np.unique(np.concatenate(hashes), return_inverse=True)
    shared = np.bincount(which, weights=1 + many, minlength=len(own)) > 1
    out, at = [], 0
    for r, h in zip(asked, hashes, strict=True):
        out.append({"kind": "anchors", "tile": r["tile"], "part": r["bucket"], "a": W.pack(np.packbits(shared[which[at : at + len(h)]])), "n": len(h)})
        at += len(h)
    return _rows(out, _PART)


def _answers(rows: list[dict], kind: str) -> np.ndarray:
    parts = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(W.unpack(r["a"]), count=r["n"]).astype(bool) for r in parts)]).astype(bool)


def _tile_of(rows: list[dict], window: int) -> _Tile:
    return _Tile(next(r for r in rows if r["kind"] == "tile"), window)


def _ask_windows(window: int, n_buckets: int):
    """A tile's distinct windows by bucket; and, in a bucket of its own that nobody else has, which window starts where."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        t, tile = _tile_of(rows, window), rows[0]["tile"]
        start, (one, two), least, which = t.windows(_answers(rows, "anchors"))
        if not len(one):
            return _rows([], _ASK)
        own = {"bucket": -1 - tile, "tile": tile, "a": W.pack_sorted(start.astype(U64)), "b": W.pack(W.small(which)), "c": None}
        bucket = _bucket(one, 64, n_buckets)
        return _rows([own, *({"bucket": int(bucket[i]), "tile": tile, "a": W.pack_sorted(one[i:j]), "b": W.pack(two[i:j]), "c": W.pack(least[i:j])} for i, j in _cuts(bucket))], _ASK)

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    asked = table.to_pylist()
    if asked[0]["bucket"] < 0:
        return _rows([{"kind": kind, "tile": r["tile"], "part": -1, "a": r[c], "n": 0} for r in asked for kind, c in (("start", "a"), ("which", "b"))], _PART)
    parts = [(W.unpack_sorted(r["a"]), W.unpack(r["b"]), W.unpack(r["c"])) for r in asked]
    one, two, least = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    first = np.flatnonzero(new)
    lowest = np.empty(len(order), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.r_[first, len(order)]))
    smaller, out, at = lowest < least, [], 0
    for r, p in zip(asked, parts, strict=True):
        n = len(p[0])
        out.append({"kind": "windows", "tile": r["tile"], "part": r["bucket"], "a": W.pack(np.packbits(smaller[at : at + n])), "n": n})
        at += n
    return _rows(out, _PART)


def _strip(window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        t = _tile_of(rows, window)
        own = {r["kind"]: r["a"] for r in rows if r["kind"] in ("start", "which")}
        doc = W.row_of(t.at)
        step = np.zeros(len(t.starts) + 1, np.int64)
        if own:
            start, which = W.unpack_sorted(own["start"]).astype(np.int64), W.unpack(own["which"]).astype(np.int64)
            smaller = _answers(rows, "windows")
            gone = smaller[which] | (t.least(start, which, len(smaller))[which] < t.ids[doc[start]])
            np.add.at(step, start[gone], 1)
            np.add.at(step, start[gone] + window, -1)
        removed = np.cumsum(step[:-1]) > 0
        text, at = joined(t.data, t.offsets, t.starts, t.ends, t.at, ~removed)
        texts = pa.Array.from_buffers(pa.large_string(), len(t.ids), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())
        n = np.diff(t.at)
        m = np.bincount(doc[removed], minlength=len(n))
        return pa.Table.from_arrays([pa.array(t.doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), texts], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), a row for each of docs; see the module.

    ``docs`` needs doc_id and text.  Null texts have no words.  A null doc_id counts as larger than
    any other and none is smaller than an equal one, so rows that repeat a doc_id strip nothing from each other.
    """
    if window < PERIOD:
        raise ValueError(f"windows have {PERIOD} words at least")
    spark = docs.sparkSession
    ws = Workspace(spark, "substrings")
    tiles = ws.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tiles, TILE), "tiles")
    total = tiles.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n = buckets_for(int(total) // 2, EACH)
    anchors = ws.save(tiles.mapInArrow(_ask_anchors(window, n), ASK).groupBy("bucket").applyInArrow(_answer_anchors, PART), "anchors")
    state = tiles.select(F.lit("tile").alias("kind"), "tile", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("a"), F.lit(0).cast("long").alias("n"), "doc_ids", "lens", "body")
    more = lambda df: df.select("kind", "tile", "part", "a", "n", F.lit(None).cast("array<bigint>").alias("doc_ids"), F.lit(None).cast("binary").alias("lens"), F.lit(None).cast("binary").alias("body"))
    first = state.unionByName(more(anchors))
    windows = ws.save(first.groupBy("tile").applyInArrow(_ask_windows(window, n), ASK).groupBy("bucket").applyInArrow(_answer_windows, PART), "windows")
    return first.unionByName(more(windows)).groupBy("tile").applyInArrow(_strip(window), RESULT)
