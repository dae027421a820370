"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their
bit counts is the embedding.  Every differing bit moves one count by one at
most, so the Manhattan distance of two embeddings is a lower bound of the
fingerprints' Hamming distance.  Written in unary (0, 1, 2 -> 00, 01, 11) an
embedding is again 64 bits, and the Manhattan distance is the number of
differing bits.

The range join under that distance is by grid cells: the 32 counts form seven
groups, and vectors within distance 4 agree in at least three whole groups, so
two fingerprints that link meet in one of the 35 grids that three groups span.
Distinct fingerprints only are dealt to cells; within a cell the lower bound
filters and the exact Hamming distance decides.  A cell yields a spanning
forest of its links, never all pairs, so a large group of near copies costs as
many rows as it has members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .workspace import Workspace, fresh

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONES = U64(0x0101010101010101)
_EVEN = 0x5555555555555555
SLICE_BYTES = 4 << 20
FEW = 512  # up to so many members, all cells' members are compared together, array by array
MANY = 4096  # beyond, a cell is first dealt again by exact blocks of bits


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows' (kept) words joined by one space: bytes and row offsets."""
    row = W.row_of(at)
    if keep is not None:
        starts, ends, row = starts[keep], ends[keep], row[keep]
    leads = np.ones(len(starts), bool)
    leads[1:] = row[1:] != row[:-1]
    step = np.zeros(len(data) + 1, np.int8)
    step[starts - ~leads] += 1
    step[ends] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    out = data[mask]
    out[W.SPACE[out]] = 0x20
    return out, np.r_[0, np.cumsum(mask)][offsets]


def shingle_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The SimHash of each row over XXH64 (seed 42) of its lower-cased k-word shingles."""
    starts, ends, at = W.word_spans(data, offsets)
    low, place = joined(_LOWER[data], offsets, starts, ends, at)
    raw = low.tobytes()
    s, e, _ = W.word_spans(low, place)
    n = np.diff(at)
    out = np.zeros(len(n), U64)
    if not len(s):
        return out
    # shingle starts: all but the last k - 1 words of a row, or the first word of a short row
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    index = np.repeat(at[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(index + k - 1, np.repeat(at[1:] - 1, many))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[i:j], 42) for i, j in zip(s[index].tolist(), e[last].tolist(), strict=True)), dtype=U64, count=len(index))
    rows = np.flatnonzero(many)
    first = (np.cumsum(many) - many)[rows]
    # lanes of eight bits count up to 255 hashes at a time
    cuts = np.concatenate([np.arange(f, f + m, 255) for f, m in zip(first.tolist(), many[rows].tolist(), strict=True)])
    heads = np.searchsorted(cuts, first)
    for bit in range(8):
        lanes = np.add.reduceat((h >> U64(bit)) & _ONES, cuts).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), heads, axis=0)
        over = 2 * ones > many[rows][:, None]
        out[rows] |= (over.astype(U64) << (np.arange(8, dtype=U64) * U64(8) + U64(bit))[None, :]).sum(1, dtype=U64)
    return out


def _fingerprint(k: int):
    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                fp = shingle_fingerprints(*W.text_bytes(piece.column("text")), k)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp long), a row for each of docs; null or wordless texts have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint(k), "doc_id long, fp long")


def _grids(groups: int, agree: int) -> list[int]:
    """The masks, over unary embeddings, of the grids: unions of ``agree`` of the groups."""
    sizes = [32 // groups + (i < 32 % groups) for i in range(groups)]
    masks, at = [], 0
    for n in sizes:
        masks.append(((1 << 2 * n) - 1) << 2 * at)
        at += n
    return [sum(c) for c in combinations(masks, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unary(fp: np.ndarray) -> np.ndarray:
    high = (fp >> U64(1)) & U64(_EVEN)
    low = fp & U64(_EVEN)
    return (low | high) | ((low & high) << U64(1))


def _forest(fp: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of the distinct fingerprints within ``most`` bits."""
    if len(fp) > MANY:
        width, out = -(-64 // (most + 1)), []
        for b in range(most + 1):
            block = (fp >> U64(b * width)) & U64((1 << width) - 1)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order]))
            for part in np.split(order, cuts + 1):
                if 1 < len(part) < len(fp):
                    out += _forest(fp[part], most)
                elif len(part) == len(fp):  # all agree in this block: nothing to gain by it
                    out += _grow(fp, most)
                    return out
        return out
    return _grow(fp, most)


def _grow(fp: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rest, wide, out = fp, unary(fp), []
    while len(rest) > 1:
        todo, rest, wide = [rest[0]], rest[1:], wide[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.flatnonzero(np.bitwise_count(wide ^ unary(np.array([x], U64))[0]) <= most)
            near = near[np.bitwise_count(rest[near] ^ x) <= most]
            if len(near):
                out.append((np.full(len(near), x), rest[near]))
                todo += list(rest[near])
                keep = np.ones(len(rest), bool)
                keep[near] = False
                rest, wide = rest[keep], wide[keep]
    return out


def _span(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (a, b) between n nodes to keep, so that they join the same nodes without most of the rest.

    In each round every component takes its first link to another one.
    """
    label, kept = np.arange(n), []
    while True:
        x, y = label[a], label[b]
        across = np.flatnonzero(x != y)
        if not len(across):
            return np.unique(np.concatenate([np.zeros(0, np.int64), *kept]))
        first = np.full(n, len(a))
        np.minimum.at(first, x[across], across)
        np.minimum.at(first, y[across], across)
        took = np.unique(first[first < len(a)])
        kept.append(took)
        while True:
            low = np.minimum(label[a[took]], label[b[took]])
            if (label[a[took]] == low).all() and (label[b[took]] == low).all():
                break
            for end in (a[took], b[took]):
                np.minimum.at(label, label[end], low)
                np.minimum.at(label, end, low)
            label = label[label]


def _hubs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among (a, b), a < b: each node's link to its smallest neighbour, then what else joins components.

    Cells that share most of their members so choose the same few links.
    """
    first = np.full(n, n)
    np.minimum.at(first, b, a)
    own = np.flatnonzero(first < n)
    label = np.where(first < n, first, np.arange(n))
    while (label[label] != label).any():
        label = label[label]
    more = _span(label[a], label[b], n)
    return np.r_[first[own], a[more]], np.r_[own, b[more]]


def _links(most: int):
    """Over batches sorted by (grid, cell, fp): links that span each cell's components."""

    def within(grid, cell, fp):
        new = np.r_[True, (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(fp)])
        behind = np.repeat(first + size, size) - np.arange(len(fp)) - 1  # members after this one
        wide, found = unary(fp), []
        i, d = np.flatnonzero(np.repeat(size <= FEW, size)), 1
        while len(i := i[behind[i] >= d]):
            near = i[np.bitwise_count(wide[i] ^ wide[i + d]) <= most]
            near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= most]
            found.append((near, near + d))
            d += 1
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
        keep = _span(a, b, len(fp))
        out = [(fp[a[keep]], fp[b[keep]])]
        for f, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            out += _forest(fp[f : f + n], most)
        a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            x = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                x = [np.concatenate(p) for p in zip(held, x, strict=True)]
            same = (x[0] == x[0][-1]) & (x[1] == x[1][-1]) if len(x[0]) else np.zeros(0, bool)
            cut = int(np.argmax(same)) if len(same) else 0
            held = [p[cut:] for p in x]
            if cut:
                yield within(x[0][:cut], x[1][:cut], x[2][:cut].view(U64))
        if held is not None and len(held[0]):
            yield within(held[0], held[1], held[2].view(U64))

    return run


def link_fingerprints(distinct: DataFrame, most: int = 4, groups: int = 7, agree: int = 3) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of ``distinct`` (fp long) within ``most`` bits."""
    if groups - most < agree:
        raise ValueError(f"vectors within {most} agree in {groups - most} of {groups} groups only")
    fp = F.col("fp")
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    wide = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    cells = F.array(*(F.struct(F.lit(i).cast("int").alias("grid"), F.col("wide").bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(_grids(groups, agree))))
    dealt = distinct.select("fp", wide.alias("wide")).select(F.explode(cells).alias("c"), "fp").select("c.grid", "c.cell", "fp")
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "grid", "cell").sortWithinPartitions("grid", "cell", "fp").mapInArrow(_links(most), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, most: int = 4, groups: int = 7, agree: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of ``most`` bits or fewer reach.

    One row per input row; equal fingerprints are one node.  Rows whose doc_id is null take part and
    get the component's smallest id that isn't null, or null if there is none.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    own = ws.save(fingerprints(docs, k), "fingerprints")
    distinct = ws.save(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = ws.save(link_fingerprints(distinct.select("fp"), most, groups, agree).distinct(), "links")
    roots = components(links, ws)
    known = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


# -- near-duplicates by Jaccard similarity ---------------------------------------------------------
#
# Texts are nodes, named by a hash.  Four seeded SimHashes of a text's set of shingles make a sketch of 256
# bits, embedded like a fingerprint above: the bit counts of its 128 segments, permuted and cut into keys of 9
# (a cell is worth about 13 bits by chance), deal it to cells.  Texts of a cell are candidates if the Manhattan
# distance of the first two words' embeddings, the lower bound, and then their Hamming distance are small.  A cell
# yields a spanning forest of them.  Of all candidates, each text's link to its smallest one is checked exactly;
# that joins most copies.  Where candidates are left whose texts are not joined, all texts of the group are compared.

SEEDS = 4
KEY_SEGMENTS, ROUNDS = 9, 12  # each round permutes the sketch's segments and cuts their counts into keys
WIDE = 34  # candidates differ in so many of 128 bits at most; 19 are expected at Jaccard 0.8
TEXTS = 256  # texts of a block when all texts of a group are compared
_KEYS = 32 * SEEDS // KEY_SEGMENTS  # of a round
_ORDERS = [np.random.default_rng(i).permutation(32 * SEEDS)[: _KEYS * KEY_SEGMENTS] for i in range(ROUNDS)]


def text_node(column) -> F.Column:
    """The node of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("")))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct lower-cased k-word shingles as hashes, ascending, and the row offsets; a shorter text is one shingle."""
    starts, ends, at = W.word_spans(data, offsets)
    h = W.word_hashes(data, starts, ends, fold=True)
    n, row = np.diff(at), W.row_of(at)
    whole = np.flatnonzero(W.whole_windows(at, k))
    hashes, rows = [W.window_hashes(h, k)[whole]], [row[whole]]
    for j in range(1, k):
        short = np.flatnonzero(n == j)
        if len(short):
            hashes.append(W.window_hashes(h, j)[at[short]])
            rows.append(short)
    h, row = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def sketch(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SEEDS words a row: the SimHashes of its set of hashes; 0 for an empty set."""
    many = np.diff(at)
    out = np.zeros((len(many), SEEDS), U64)
    rows = np.flatnonzero(many)
    if not len(rows):
        return out
    size, first = many[rows], at[:-1][rows]
    parts = -(-size // 255)  # lanes of eight bits count up to 255 hashes at a time
    heads = np.cumsum(parts) - parts
    cuts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(heads, parts))
    for seed in range(SEEDS):
        x = W.mix(h + U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for bit in range(8):
            lanes = np.add.reduceat((x >> U64(bit)) & _ONES, cuts).view(np.uint8).reshape(-1, 8)
            over = 2 * np.add.reduceat(lanes.astype(np.int64), heads, axis=0) > size[:, None]
            out[rows, seed] |= (over.astype(U64) << (np.arange(8, dtype=U64) * U64(8) + U64(bit))[None, :]).sum(1, dtype=U64)
    return out


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                x = sketch(*shingle_sets(*W.text_bytes(piece.column("text")), k))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "node", "sketch"])

    return run


def _deal(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            piece = batch.slice(i, 1024)
            x = np.frombuffer(b"".join(piece.column("sketch").to_pylist()), U64).reshape(-1, SEEDS)
            bits = np.unpackbits(np.ascontiguousarray(unary(x)).view(np.uint8), axis=1, bitorder="little")
            counts = (bits[:, ::2] + bits[:, 1::2]).astype(np.int32)
            places = 3 ** np.arange(KEY_SEGMENTS, dtype=np.int32)
            keys = np.hstack([counts[:, order].reshape(len(x), _KEYS, KEY_SEGMENTS) @ places for order in _ORDERS])
            keys += np.arange(keys.shape[1], dtype=np.int32) * np.int32(3**KEY_SEGMENTS)
            each = keys.shape[1]
            columns = [np.repeat(c, each) for c in (piece.column("node").to_numpy(), x[:, 0].view(np.int64), x[:, 1].view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *map(pa.array, columns)], names=["cell", "node", "f0", "f1"])


def _close(f0: np.ndarray, f1: np.ndarray, g0: np.ndarray, g1: np.ndarray) -> np.ndarray:
    """Which pairs of words are near: by the lower bound of their embeddings, then by their bits."""
    near = np.bitwise_count(unary(f0) ^ unary(g0)) + np.bitwise_count(unary(f1) ^ unary(g1)) <= WIDE
    return near & (np.bitwise_count(f0 ^ g0) + np.bitwise_count(f1 ^ g1) <= WIDE)


def _wide_grow(node: np.ndarray, f0: np.ndarray, f1: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    while len(node) > 1:
        todo = [(node[0], f0[0], f1[0])]
        node, f0, f1 = node[1:], f0[1:], f1[1:]
        while todo and len(node):
            x, y0, y1 = todo.pop()
            near = _close(f0, f1, y0, y1)
            if near.any():
                out.append((np.full(near.sum(), x), node[near]))
                todo += zip(node[near], f0[near], f1[near], strict=True)
                node, f0, f1 = node[~near], f0[~near], f1[~near]
    return out


def _candidates(batches):
    """Over batches sorted by (cell, node): links that span the candidates of each cell."""

    def within(cell, node, f0, f1):
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[first, len(cell)])
        behind = np.repeat(first + size, size) - np.arange(len(cell)) - 1
        w0, w1 = unary(f0), unary(f1)
        found, i, d = [], np.flatnonzero(np.repeat(size <= FEW, size)), 1
        while len(i := i[behind[i] >= d]):
            near = i[np.bitwise_count(w0[i] ^ w0[i + d]) + np.bitwise_count(w1[i] ^ w1[i + d]) <= WIDE]
            near = near[np.bitwise_count(f0[near] ^ f0[near + d]) + np.bitwise_count(f1[near] ^ f1[near + d]) <= WIDE]
            found.append((near, near + d))
            d += 1
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
        a, b = _hubs(a, b, len(cell))
        out = [(node[a], node[b])]
        for f, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            out += _wide_grow(*(c[f : f + n] for c in (node, f0, f1)))
        a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held = None
    for batch in batches:
        x = [batch.column(i).to_numpy() for i in range(4)]
        x = [x[0], x[1], x[2].view(U64), x[3].view(U64)]
        if held is not None:
            x = [np.concatenate(p) for p in zip(held, x, strict=True)]
        cut = int(np.searchsorted(x[0], x[0][-1])) if len(x[0]) else 0
        held = [p[cut:] for p in x]
        if cut:
            yield within(*(p[:cut] for p in x))
    if held is not None and len(held[0]):
        yield within(*held)


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that span the candidates among ``nodes`` (node, sketch)."""
    dealt = nodes.select("node", "sketch").mapInArrow(_deal, "cell int, node long, f0 long, f1 long")
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "cell").sortWithinPartitions("cell", "node").mapInArrow(_candidates, "a long, b long").distinct()


def _packed_sets(k: int):
    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                h, at = shingle_sets(*W.text_bytes(piece.column("text")), k)
                sets = [W.pack_sorted(h[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _similar(similarity: float):
    def run(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                a, b = W.unpack_sorted(a), W.unpack_sorted(b)
                common = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(common >= similarity * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def check_links(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """links (a, b) with ok: whether the texts' sets of shingles have that Jaccard similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return links.join(left, "a").join(right, "b").mapInArrow(_similar(similarity), "a long, b long, ok boolean")


def _all_pairs(similarity: float):
    """Over the texts (label, shingles) of one or two blocks: links between labels that similar texts join."""

    def run(table: pa.Table) -> pa.Table:
        names, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        sets = [W.unpack_sorted(x) for x in table.column("shingles").to_pylist()]
        size, n = np.array(list(map(len, sets))), len(sets)
        _, column, count = np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(n), size), count[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((n, n), np.float32)
        for i in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, (i, i + 4096))
            x = np.zeros((n, 4096), np.float32)
            x[row[lo:hi], column[lo:hi] - i] = 1
            common += x @ x.T
        ok = (common >= similarity * (size[:, None] + size[None, :] - common.astype(np.float64))) & (label[:, None] < label[None, :])
        a, b = (label[x] for x in np.nonzero(ok))
        keep = _span(a, b, len(names))
        return pa.Table.from_arrays([pa.array(names[a[keep]]), pa.array(names[b[keep]])], names=["a", "b"])

    return run


def compare_all(members: DataFrame, sets: DataFrame, ws: Workspace, similarity: float) -> DataFrame:
    """Links (a, b) between the labels of a group that similar texts join, from all pairs of texts of different labels.

    members: (node, label, g).  A group's texts are dealt to blocks of about TEXTS; those of a large label have
    blocks of their own, which aren't compared with each other.  A task compares the texts of two blocks.
    """
    sizes = members.groupBy("g", "label").agg(F.count(F.lit(1)).alias("size"))
    pools = sizes.groupBy("g").agg(F.sum(F.when(F.col("size") < TEXTS, F.col("size"))).alias("pool"))
    large, part = F.col("size") >= TEXTS, lambda key, of: F.pmod(F.xxhash64(key), F.ceil(F.col(of) / TEXTS).cast("long"))
    own = F.xxhash64(F.lit(1), "label", part("node", "size"))
    pooled = F.xxhash64(F.lit(0), "g", part("label", "pool"))
    placed = members.join(sizes, ["g", "label"]).join(pools, "g").select("g", "label", "node", F.when(large, F.col("label")).alias("own"), F.when(large, own).otherwise(pooled).alias("block"))
    placed = ws.save(placed, "placed")
    blocks = placed.select("g", "block", "own").distinct()
    left, right = (blocks.select("g", F.col("block").alias(x), F.col("own").alias(f"own_{x}")) for x in "pq")
    pairs = left.join(right, "g").where("p <= q and not (own_p is not null and own_p <=> own_q)").select("p", "q")
    dealt = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block")).join(placed.select("block", "node", "label"), "block").join(sets, "node")
    return dealt.select("p", "q", "label", "shingles").groupBy("p", "q").applyInArrow(_all_pairs(similarity), "a long, b long")


def similar_components(nodes: DataFrame, texts: DataFrame, ws: Workspace, k: int, similarity: float) -> DataFrame:
    """(node, root) of the texts (node, text) that links of that similarity join; nodes: (node, sketch)."""
    found = ws.save(candidate_links(nodes), "candidates")
    met = ws.save(found.select(F.col("a").alias("node")).union(found.select("b")).distinct(), "met")
    chosen = texts.join(met, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = ws.save(chosen.mapInArrow(_packed_sets(k), "node long, shingles binary"), "sets")
    first = ws.save(found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    checked = ws.save(check_links(first, sets, similarity), "checked")
    labels = components(checked.where("ok").select("a", "b"), Workspace(ws.spark, "similar")).withColumnRenamed("root", "label")
    # groups: what the first links join, and then the few candidates between those
    near = components(first, Workspace(ws.spark, "near")).withColumnRenamed("root", "tree")
    known = ws.save(met.join(labels, "node", "left").join(near, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("tree", "node").alias("tree")), "known")
    left, right = (known.select(F.col("node").alias(c), F.col("tree").alias(f"t{c}")) for c in "ab")
    across = found.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb")).distinct()
    far = components(ws.save(across, "across"), Workspace(ws.spark, "far")).withColumnRenamed("node", "tree")
    placed = ws.save(known.join(far, "tree", "left").select("node", "label", F.coalesce("root", "tree").alias("g")), "grouped")
    apart = placed.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("g")
    more = ws.save(compare_all(placed.join(apart, "g", "left_semi"), sets, ws, similarity).distinct(), "more")
    joined = components(more, Workspace(ws.spark, "joined")).withColumnRenamed("node", "label")
    return placed.join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("root"))


def one_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar texts: that with the smallest doc_id (then hash of the text), once if it is repeated.

    All columns stay.  Rows whose doc_id is null have no place in that order and stay.
    """
    ws = Workspace(docs.sparkSession, "one-of-each")
    texts = docs.select(F.col("doc_id").cast("long"), text_node(F.col("text")).alias("node"), F.col("text").cast("string"))
    own = ws.save(texts.mapInArrow(_sketches(k), "doc_id long, node long, sketch binary"), "sketches")
    nodes = ws.save(own.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")), "nodes")
    roots = similar_components(nodes, texts.select("node", "text"), ws, k, similarity)
    known = nodes.join(roots, "node", "left").where("least is not null").select("least", "node", F.coalesce("root", "node").alias("root"))
    least = known.groupBy("root").agg(F.min(F.struct(F.col("least").alias("doc_id"), "node")).alias("first")).select("first.doc_id", "first.node")
    key, name, many = fresh(docs.columns, "kept_id", "kept_node", "kept_many")
    counts = own.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias(many))
    kept = ws.save(counts.join(least, ["doc_id", "node"]).select(F.col("doc_id").alias(key), F.col("node").alias(name), many), "kept")
    both = docs.join(kept.hint("shuffle_hash"), (docs["doc_id"].cast("long") == kept[key]) & (text_node(docs["text"]) == kept[name]))
    once = both.where(F.col(many) == 1).drop(key, name, many)
    again = both.where(F.col(many) > 1).drop(many).dropDuplicates([key, name]).drop(key, name)
    return once.unionByName(again).unionByName(docs.where(F.col("doc_id").isNull()))
