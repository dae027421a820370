"""Finds short benchmark items inside long documents by size-partitioned MinHash containment search.

Item and document are sets of five-word shingles (lower-cased A-Z).  An item
is contained if at least ``threshold`` of its distinct shingles occur in the
document.  Containment isn't Jaccard similarity: a document may be a thousand
times longer, so MinHash signatures of one length for both sides would hardly
ever meet.  Items are therefore partitioned by their number q of shingles.  An
item's MinHash sketch is its q - ceil(threshold * q) + 1 smallest hashes, and
the largest of all sketches of a partition is the partition's ceiling; a
document's sketch is every hash of its shingles up to a ceiling.  A document
that holds the item lacks at most q - ceil(threshold * q) of its shingles, so
at least one hash of the item's sketch is in the document's: no contained item
is missed, however long the document.  Candidates are verified by exact
containment of the shingles' words.

Items of ``BLOCK_BYTES`` of text together are indexed once and broadcast, and
documents take one narrow pass.  A larger table of items is never gathered:
the sketches of both sides meet in a join on their hashes, whose large keys
adaptive execution splits, and candidates in joins on the texts' digests.

Items or documents with fewer than five words have one shingle, all of their
words; without words, none, and nothing is contained.
"""

from __future__ import annotations

from collections import defaultdict
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .workspace import Workspace, fresh

U64 = np.uint64
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
RESULT = "doc_id long, item_id long, n_item_shingles long, n_common long, containment double"


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hash of each k-word shingle, its row, and (starts, ends, at) of the words.  Short rows have one."""
    starts, ends, at = W.word_spans(data, offsets)
    words = W.word_hashes(data, starts, ends, fold=True)
    n = np.diff(at)
    ok = np.flatnonzero(W.whole_windows(at, k)) if len(words) else np.zeros(0, np.int64)
    h, row = (W.window_hashes(words, k)[ok] if len(ok) else np.zeros(0, U64)), W.row_of(at)[ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.array([_short(words[at[i] : at[i + 1]]) for i in short], U64)
        h, row = np.r_[h, extra], np.r_[row, short]
    return h, row, (starts, ends, at)


def _short(words: np.ndarray) -> int:
    return int(W.window_hashes(words, len(words))[0] ^ U64(len(words)))


def word_shingles(text: bytes, k: int) -> set[bytes]:
    words = text.translate(_FOLD).split()
    if not words:
        return set()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def needed(q: int, threshold: float) -> int:
    """The fewest of q shingles that make an item contained."""
    return max(1, ceil(threshold * q - 1e-9))


class ItemIndex:
    """Signatures of one block of items, by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int, threshold: float):
        self.items = []
        posting = defaultdict(list)
        by_size = defaultdict(list)
        for item_id, text in items:
            shingles = word_shingles((text or "").encode(), k)
            if shingles:
                by_size[len(shingles)].append((item_id, shingles, (text or "").encode()))
        for q, own in sorted(by_size.items()):
            length = q - needed(q, threshold) + 1
            for item_id, shingles, text in own:
                h, _, _ = shingle_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), k)
                for x in np.unique(h)[:length].tolist():
                    posting[x].append(len(self.items))
                self.items.append((item_id, shingles))
        self.hashes = np.array(sorted(posting), U64)
        self.postings = [posting[x] for x in self.hashes.tolist()]


def _search(index, k: int, threshold: float):
    def run(batches):
        own = index.value
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                data, offsets = W.text_bytes(piece.column("text"))
                h, row, _ = shingle_hashes(data, offsets, k)
                place = np.searchsorted(own.hashes, h)
                hit = np.flatnonzero(own.hashes[np.minimum(place, len(own.hashes) - 1)] == h) if len(own.hashes) else []
                found = defaultdict(set)
                for r, p in {*zip(row[hit].tolist(), place[hit].tolist(), strict=True)} if len(hit) else ():
                    found[r].update(own.postings[p])
                out, ids = [], piece.column("doc_id")
                for r, candidates in sorted(found.items()):
                    shingles = word_shingles(data[offsets[r] : offsets[r + 1]].tobytes(), k)
                    for c in sorted(candidates):
                        item_id, wanted = own.items[c]
                        common = len(wanted & shingles)
                        if common >= needed(len(wanted), threshold):
                            out.append((ids[r].as_py(), item_id, len(wanted), common, common / len(wanted)))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    names = ("doc_id", "item_id", "n_item_shingles", "n_common", "containment")
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    return run


def _small(items: DataFrame) -> list | None:
    """The items (item_id, text) if their texts hold BLOCK_BYTES at most, else None."""
    own = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = own.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    return [(r[0], r[1]) for r in own.collect()] if size <= BLOCK_BYTES else None


def _node(text) -> F.Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def size_class(q: int) -> int:
    """Partition of an item by its size: sizes that differ by less than twice go together."""
    return q.bit_length() - 1


def _item_sketches(k: int, threshold: float):
    def run(batches):
        for batch in batches:
            rows = []
            for node, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                h = np.unique(shingle_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), k)[0])
                q = len(word_shingles(raw, k))
                rows += [(node, size_class(q), x) for x in h[: q - needed(q, threshold) + 1].view(np.int64).tolist()] if q else []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["item", "size_class", "hash"])

    return run


def _doc_sketches(k: int, ceiling: int):
    """The distinct hashes of each text up to the ceiling."""

    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                h, row, _ = shingle_hashes(*W.text_bytes(piece.column("text")), k)
                low = h <= U64(ceiling)
                h, row = h[low], row[low]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([piece.column("doc").take(pa.array(row[new])), pa.array(h[new].view(np.int64))], names=["doc", "hash"])

    return run


def _verify(k: int, threshold: float):
    def run(batches):
        for batch in batches:
            out = []
            for doc, item, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc", "item", "doc_text", "item_text")), strict=True):
                wanted = word_shingles((b or "").encode(), k)
                common = len(wanted & word_shingles((a or "").encode(), k))
                if wanted and common >= needed(len(wanted), threshold):
                    out.append((doc, item, len(wanted), common, common / len(wanted)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 5, kinds, strict=True)], names=["doc", "item", "n_item_shingles", "n_common", "containment"])

    return run


def _join_sketches(docs: DataFrame, items: DataFrame, ws: Workspace, k: int, threshold: float) -> DataFrame:
    """(doc, item, n_item_shingles, n_common, containment) of texts, known by digests, that contain items' texts.

    docs and items have a column text each; equal texts are one.
    """
    texts = lambda df, name: df.select(_node(F.col("text")).alias(name), F.col("text").cast("string").alias("text")).where("text is not null").groupBy(name).agg(F.first("text").alias("text"))
    own_docs, own_items = texts(docs, "doc"), ws.save(texts(items, "item"), "items")
    sketches = ws.save(own_items.mapInArrow(_item_sketches(k, threshold), "item string, size_class int, hash long"), "sketches")
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))  # so that signed order is the hashes' order
    ceilings = {r["size_class"]: (r["top"] ^ -(1 << 63)) % (1 << 64) for r in sketches.groupBy("size_class").agg(F.max(unsigned).alias("top")).collect()}
    if not ceilings:
        return docs.sparkSession.createDataFrame([], "doc string, item string, n_item_shingles long, n_common long, containment double")
    low = own_docs.mapInArrow(_doc_sketches(k, max(ceilings.values())), "doc string, hash long")
    pairs = ws.save(low.join(sketches, "hash").select("doc", "item").distinct(), "pairs")
    both = pairs.join(own_docs.withColumnRenamed("text", "doc_text"), "doc").join(own_items.withColumnRenamed("text", "item_text"), "item")
    return ws.save(both.select("doc", "item", "doc_text", "item_text").mapInArrow(_verify(k, threshold), "doc string, item string, n_item_shingles long, n_common long, containment double"), "found")


def find_contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_common, containment), a row for each contained item and row of docs.

    docs needs doc_id and text, items item_id and text.  Null texts have no words.  Repeated items or
    rows are found as often as they come.
    """
    spark = docs.sparkSession
    small = _small(items)
    if small is not None:
        index = spark.sparkContext.broadcast(ItemIndex(small, k, threshold))
        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_search(index, k, threshold), RESULT)
    found = _join_sketches(docs, items, Workspace(spark, "decontaminate"), k, threshold)
    doc_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node(F.col("text")).alias("doc"))
    item_rows = items.select(F.col("item_id").cast("long").alias("item_id"), _node(F.col("text")).alias("item"))
    return found.join(doc_rows, "doc").join(item_rows, "item").select("doc_id", "item_id", "n_item_shingles", "n_common", "containment")


def remove_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that contain an item; all columns stay.

    Null texts have no words and stay, as do rows with a null doc_id; repeated rows stay or go together.
    """
    spark = docs.sparkSession
    small = _small(items)
    if small is not None:
        return docs.mapInArrow(_clean(spark.sparkContext.broadcast(ItemIndex(small, k, threshold)), k, threshold), docs.schema)
    (key,) = fresh(docs.columns, "contaminated")
    gone = _join_sketches(docs, items, Workspace(spark, "decontaminate"), k, threshold).select(F.col("doc").alias(key)).distinct()
    return docs.join(gone, _node(docs["text"]) == gone[key], "left_anti")


def _clean(index, k: int, threshold: float):
    search = _search(index, k, threshold)

    def run(batches):
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], names=["doc_id", "text"])
            gone = np.zeros(batch.num_rows, bool)
            for found in search([numbered]):
                gone[found.column("doc_id").to_numpy()] = True
            yield batch.filter(pa.array(~gone))

    return run
