"""Embedding near-duplicates by a robust-pruned flat graph.

1. Vectors that are equal are one node.  A bounded sample of the nodes
   (``SAMPLE``) yields cluster centres; every node joins its ``overlap``
   nearest clusters, so the shards overlap.  A shard that comes out larger than
   ``LARGE`` is split by centres of its own, again from a bounded sample.
2. Each shard builds a graph by insertion: for each new member a greedy search
   over the members before it gives near candidates; they and some random ones
   are pruned robustly: a candidate goes if one already chosen is closer to it,
   by the factor alpha, than the member is.  Chosen members link back.
3. A node's adjacency lists from all its shards are united and handed back.
4. In each shard every member is a query: a greedy search starts from the
   medoids of the shard's parts, expands the best ``beam`` nodes, and goes on
   expanding as long as unexpanded nodes lie within the similarity threshold.
   Pairs found from either end are verified in double precision and count for
   both.  A pair that two shards hold is counted in the first only.
5. Recall is audited: for a bounded sample of nodes all links to other nodes
   are counted by brute force, and the mean of the nodes' recalls is taken, so
   one large group can't hide what others lose.  Below ``RECALL`` the build is
   repeated with twice the overlap and the beam.  After ``TRIES`` the links are
   computed exactly, block by block; beyond ``EXACT`` nodes, where that would
   not end, the operator raises.  It never returns a result below ``RECALL``.

Shards return counts of links and a spanning forest, never pairs.  Distances
within a shard are taken in blocks.  Vectors that are null, zero or hold a
null or non-finite component link with nothing; vectors of different lengths
have no cosine and don't link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .workspace import Workspace

SAMPLE = 32_768
SHARD, LARGE = 400, 2000  # members of a shard, about, before overlap; members from which it is split
MOST_CENTRES, SPLITS = 4096, 4  # centres of one round, rounds of splitting
NEAR, FAR, KEEP_NEAR, KEEP_FAR, ALPHA = 40, 16, 20, 8, 1.2
SEED, INSERT, LOOK = 128, 256, 24  # members to start with, members inserted at once, nodes expanded for each
BATCH, AT_ONCE = 256, 4
AUDIT, RECALL, TRIES = 512, 0.9, 3
BLOCK = 512
EXACT, EXACT_BLOCK = 1 << 20, 2048
PAIR_CELLS = 1 << 24  # pairs times pairs of their shards that are compared at once


def _normalise(batches):
    for batch in batches:
        ids, vectors, sizes = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = None
            if i is not None and v and all(c is not None for c in v):
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None
            ids.append(i)
            vectors.append(None if x is None else (x / np.linalg.norm(x)).tobytes())
            sizes.append(None if x is None else len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(vectors, pa.binary())], names=["vec_id", "dim", "v"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k-means centres of unit vectors; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds if len(c) > 1 else 0):
        own = np.concatenate([np.argmax(x[i : i + BLOCK] @ c.T, axis=1) for i in range(0, len(x), BLOCK)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def _assign(shared, overlap: int):
    """Deals nodes to shards; shared: centres by the shard that they split (-1: none), and the number of their first shard."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, old = _matrix(batch.column("v")), batch.column("shards").to_pylist()
            new: list[set] = [{s for s in own if s not in shared.value} for own in old]
            for split, (c, first) in shared.value.items():
                rows = np.array([i for i, own in enumerate(old) if split in own], np.int64)
                n = min(overlap, len(c) if split < 0 else max(1, len(c) // 2))  # else what is split would not get smaller
                for i in range(0, len(rows), BLOCK):
                    part = rows[i : i + BLOCK]
                    near = np.argsort(-(x[part] @ c.T), axis=1, kind="stable")[:, :n]
                    for r, own in zip(part.tolist(), (near + first).tolist(), strict=True):
                        new[r].update(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("node", "many", "v")), pa.array([sorted(s) for s in new], pa.list_(pa.int32()))], names=["node", "many", "v", "shards"])

    return run


def robust_prune(x: np.ndarray, p: np.ndarray, pool: np.ndarray, keep: int) -> np.ndarray:
    """For points p (rows of x) the chosen of their pools, nearest first; -1 where none.

    Distances are squared chords of unit vectors, so alpha applies squared.
    """
    own = x[p]
    d = 2 - 2 * np.einsum("id,ijd->ij", own, x[pool])
    order = np.argsort(d, axis=1, kind="stable")
    pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
    y = x[pool]
    between = 2 - 2 * np.einsum("ijd,ikd->ijk", y, y)
    alive = pool != p[:, None]
    alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    chosen, count = np.zeros_like(alive), np.zeros(len(p), int)
    for j in range(pool.shape[1]):
        take = alive[:, j] & (count < keep)
        chosen[:, j] = take
        count += take
        gone = take[:, None] & (ALPHA**2 * between[:, j] <= d)
        gone[:, : j + 1] = False
        alive &= ~gone
    out = np.full((len(p), keep), -1)
    rows, cols = np.nonzero(chosen)
    place = np.cumsum(chosen, axis=1)[rows, cols] - 1
    out[rows, place] = pool[rows, cols]
    return out


class Adjacency:
    """Out-links of members (-1 padded): pruned near ones, pruned far ones, and the nearest of the links that lead here."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        self.out = np.full((n, KEEP_NEAR + KEEP_FAR + KEEP_NEAR), -1)
        self.back_sim = np.full((n, KEEP_NEAR), -2.0)

    def put(self, p: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        self.out[p, :KEEP_NEAR], self.out[p, KEEP_NEAR : KEEP_NEAR + KEEP_FAR] = near, far
        r, k = np.nonzero(near >= 0)
        at, to = p[r], near[r, k]
        sim = np.einsum("ij,ij->i", self.x[at], self.x[to])
        order = np.argsort(to, kind="stable")
        at, to, sim = at[order], to[order], sim[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        for turn in range(int(place.max(initial=-1)) + 1):
            i = np.flatnonzero(place == turn)
            slot = np.argmin(self.back_sim[to[i]], axis=1)
            ok = sim[i] > self.back_sim[to[i], slot]
            i, slot = i[ok], slot[ok]
            self.back_sim[to[i], slot] = sim[i]
            self.out[to[i], KEEP_NEAR + KEEP_FAR + slot] = at[i]


def build(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Adjacency (rows of member numbers, -1 padded) of a shard's vectors, by insertion in random order."""
    n = len(x)
    rng = np.random.default_rng(seed)
    order, graph, small = rng.permutation(n), Adjacency(x), x.astype(np.float32)
    done = 0
    while done < n:
        p = order[done : done + (SEED if not done else min(INSERT, done))]
        sim = small[p] @ small[p].T  # of those inserted together
        ids = np.broadcast_to(p, (len(p), len(p)))
        if done:
            starts = order[: min(done, 16)]
            seen = np.concatenate([walk(small, graph.out, starts, p[i : i + BATCH], LOOK, 2.0) for i in range(0, len(p), BATCH)])
            k = min(NEAR, done)
            best = np.argpartition(-seen, k - 1, axis=1)[:, :k]
            sim, ids = np.hstack([sim, np.take_along_axis(seen, best, 1)]), np.hstack([ids, best])
        k = min(NEAR, ids.shape[1])
        pool = np.take_along_axis(ids, np.argpartition(-sim, k - 1, axis=1)[:, :k], 1)
        far = order[rng.integers(0, min(n, done + len(p)), (len(p), FAR))]
        near = np.concatenate([robust_prune(x, p[j : j + 128], pool[j : j + 128], KEEP_NEAR) for j in range(0, len(p), 128)])
        graph.put(p, near, np.concatenate([robust_prune(x, p[j : j + 128], far[j : j + 128], KEEP_FAR) for j in range(0, len(p), 128)]))
        done += len(p)
    return graph.out


def _build(table: pa.Table) -> pa.Table:
    node, x = table.column("node").to_numpy(), _matrix(table.column("v"))
    order = np.argsort(node)
    node, x = node[order], x[order]
    lists = [node[r[r >= 0]].tolist() for r in build(x)]
    return pa.Table.from_arrays([pa.array(node), pa.array(lists, pa.list_(pa.int64()))], names=["node", "near"])


def walk(small: np.ndarray, adjacent: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, low: float) -> np.ndarray:
    """Greedy search for members q: similarities of all members (-2: not seen).

    The best ``beam`` nodes are expanded, and beyond that all whose similarity reaches ``low``.
    """
    n = len(small)
    sim = np.full((len(q), n), -2, np.float32)  # of the nodes seen
    sim[:, starts] = small[q] @ small[starts].T
    todo = sim.copy()  # of those not expanded yet
    active, spent = np.arange(len(q)), 0
    while len(active):
        chosen = []
        part = todo[active]
        for _ in range(AT_ONCE):
            best = np.argmax(part, axis=1)
            value = part[np.arange(len(active)), best]
            go = (value > -2) & ((spent < beam) | (value >= low))
            part[np.arange(len(active)), best] = -2
            chosen.append(np.where(go, best, -1))
        spent += AT_ONCE
        c = np.stack(chosen, axis=1)
        r, k = np.nonzero(c >= 0)
        todo[active[r], c[r, k]] = -2
        going = (c >= 0).any(axis=1)
        active, c = active[going], c[going]
        if not len(active):
            break
        near = np.where(c[:, :, None] >= 0, adjacent[c], -1).reshape(len(active), -1)
        r, k = np.nonzero(near >= 0)
        a, b = active[r], near[r, k]
        new = sim[a, b] <= -2
        pair = np.unique(a[new] * n + b[new])
        a, b = pair // n, pair % n
        s = np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", small[q[a[j : j + 65536]]], small[b[j : j + 65536]]) for j in range(0, len(a), 65536))])
        sim[a, b] = s
        todo[a, b] = s
    return sim


def search(x: np.ndarray, adjacent: np.ndarray, starts: np.ndarray, queries: np.ndarray, threshold: float, beam: int):
    """Yields (query, found) member numbers within the threshold, a batch of queries at a time."""
    small, low = x.astype(np.float32), threshold - 1e-4
    step = max(16, min(BATCH, (1 << 22) // max(1, len(x))))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        a, b = np.nonzero(walk(small, adjacent, starts, q, beam, low) >= low)
        a = q[a]
        other = a != b
        a, b = a[other], b[other]
        ok = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[a[j : j + 65536]], x[b[j : j + 65536]]) >= threshold for j in range(0, len(a), 65536))])
        yield a[ok], b[ok]


def _linked(bits: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of members i to j, from the bit matrix."""
    a, b = np.nonzero(np.unpackbits(bits[i:j], axis=1, bitorder="little"))
    return a + i, b


def tie(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest label on either side of each link, until they agree."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        for end in (label[a], label[b], a, b):
            np.minimum.at(label, end, low)
        label = label[label]


def _members(node: np.ndarray, lists: pa.Array) -> np.ndarray:
    """The lists' nodes as member numbers (-1 padded), without those that aren't among ``node`` (ascending)."""
    n, own = len(node), lists.flatten().to_numpy()
    row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    at = np.minimum(np.searchsorted(node, own), n - 1)
    here = node[at] == own
    row, at = row[here], at[here]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full((n, int(place.max(initial=0)) + 1), -1)
    out[row, place] = at
    return out


def _search(threshold: float, beam: int):
    schema = pa.schema([("kind", pa.string()), ("node", pa.int64()), ("value", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        node = table.column("node").to_numpy()
        order = np.argsort(node)
        node, many = node[order], table.column("many").to_numpy()[order]
        x = _matrix(table.column("v"))[order]
        shards = table.column("shards").to_pylist()
        shards = [shards[i] for i in order]
        n, adjacent = len(node), _members(node, table.column("near").take(pa.array(order)).combine_chunks())
        member = np.full((n, max(map(len, shards))), -1)
        for i, s in enumerate(shards):
            member[i, : len(s)] = s
        c = centres(x, int(np.ceil(np.sqrt(n))), rounds=3)
        starts = np.unique(np.concatenate([np.argmax(x @ part.T, axis=0) for part in np.array_split(c, -(-len(c) // 64))]))
        links, label = np.zeros(n, np.int64), np.arange(n)
        bits = np.zeros((n, -(-n // 8)), np.uint8)  # both directions of every link found
        for a, b in search(x, adjacent, starts, np.arange(n), threshold, beam):
            for u, v in ((a, b), (b, a)):
                np.bitwise_or.at(bits, (u, v >> 3), np.left_shift(1, v & 7).astype(np.uint8))
        step, each = max(1, (1 << 22) // n), min(65536, max(256, PAIR_CELLS // member.shape[1] ** 2))
        for i in range(0, n, step):
            a, b = _linked(bits, i, i + step)
            for j in range(0, len(a), each):
                u, v = a[j : j + each], b[j : j + each]
                earlier = ((member[u][:, :, None] == member[v][:, None, :]) & (member[u] >= 0)[:, :, None] & (member[u] < shard)[:, :, None]).any((1, 2))
                np.add.at(links, u[~earlier], many[v[~earlier]])
                label = tie(label, u, v)
        for _ in range(64):
            label = label[label]
        tied = label != np.arange(n)
        kinds = ["links"] * n + ["tie"] * int(tied.sum())
        return pa.Table.from_arrays([pa.array(kinds), pa.array(np.r_[node, node[tied]]), pa.array(np.r_[links, node[label[tied]]])], schema=schema)

    return run


def _count_links(shared, threshold: float):
    """For each block of nodes, how many rows link with each audited node."""

    def run(batches):
        ids, x = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                y, many = _matrix(batch.column("v")), batch.column("many").to_numpy()
                other = batch.column("node").to_numpy()[None, :] != ids[:, None]
                for i in range(0, len(y), BLOCK):
                    total += ((x @ y[i : i + BLOCK].T >= threshold) & other[:, i : i + BLOCK]) @ many[i : i + BLOCK]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "true_links"])

    return run


def audit(nodes: DataFrame, linked: DataFrame, threshold: float) -> float:
    """The mean, over AUDIT nodes with links, of the share of them that ``linked`` (node, links) has.

    nodes: (node, many, v) of one length; brute force over all of them.
    """
    some = nodes.orderBy(F.xxhash64("node"), "node").select("node", "v").limit(AUDIT).collect()
    if not some:
        return 1.0
    x = np.frombuffer(b"".join(bytes(r["v"]) for r in some), np.float64).reshape(len(some), -1)
    shared = nodes.sparkSession.sparkContext.broadcast((np.array([r["node"] for r in some]), x))
    true = nodes.select("node", "many", "v").mapInArrow(_count_links(shared, threshold), "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
    share = F.least(F.coalesce("links", F.lit(0)), "true_links") / F.col("true_links")
    mean = true.where("true_links > 0").join(linked, "node", "left").agg(F.avg(share)).first()[0]
    return 1.0 if mean is None else mean


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, overlap: int = 3, beam: int = 32) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each of vectors (vec_id, embedding); see the module.

    A null vec_id links with nothing and is its own component.  Rows that repeat a vec_id with equal vectors are one
    node whose rows link with each other.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "flatgraph")
    rows = ws.save(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_normalise, "vec_id long, dim int, v binary"), "rows")
    nodes = ws.save(rows.where("v is not null").groupBy("dim", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("many")), "nodes")
    every = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for dim in sorted(r[0] for r in nodes.select("dim").distinct().collect()):
        own = nodes.where(F.col("dim") == dim)
        linked = link(own, ws, str(dim), threshold, overlap, beam)
        known = own.join(linked, "node").select("dim", "v", "component_id", (F.col("links") + F.col("many") - 1).alias("n_links"))
        every = every.unionByName(rows.where(F.col("dim") == dim).join(known, ["dim", "v"]).select("vec_id", "n_links", "component_id"))
    return every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def link(nodes: DataFrame, ws: Workspace, name: str, threshold: float, overlap: int, beam: int) -> DataFrame:
    """(node, links, component_id) of nodes (node, many, v) of one length, with an audited recall of RECALL at least."""
    for attempt in range(TRIES):
        out = _link(nodes, ws, f"{name}-{attempt}", threshold, overlap << attempt, beam << attempt)
        if audit(nodes, out, threshold) >= RECALL:
            return out
    n = nodes.count()
    if n > EXACT:
        raise RuntimeError(f"recall is below {RECALL} after {TRIES} tries, and {n} vectors are too many to compare exactly")
    return exact(nodes, ws, f"{name}-exact", n, threshold)


def _grouped(found: DataFrame, ws: Workspace) -> DataFrame:
    """(node, links, component_id) from rows of kind links and tie."""
    links = found.where("kind = 'links'").groupBy("node").agg(F.sum("value").alias("links"))
    roots = components(found.where("kind = 'tie'").select("node", "value"), Workspace(ws.spark, "flatgraph"))
    return links.join(roots, "node", "left").select("node", "links", F.coalesce("root", "node").alias("component_id"))


def _centres(sc, picked: list, k: int) -> np.ndarray:
    x = np.frombuffer(b"".join(bytes(r) for r in picked), np.float64).reshape(len(picked), -1)
    return centres(x, max(1, min(MOST_CENTRES, len(x) // 4 or 1, k)))


def shards(nodes: DataFrame, ws: Workspace, name: str, n: int, overlap: int) -> DataFrame:
    """(node, many, v, shards): nodes with their shards' numbers, ascending."""
    sc = nodes.sparkSession.sparkContext
    held = nodes.select("node", "many", "v", F.array(F.lit(-1)).alias("shards"))
    sizes, first = {-1: n}, 0
    for k in range(SPLITS + 1):
        each = max(1, sum(sizes.values()) // SAMPLE)
        mine = held.select("node", "v", F.explode("shards").alias("s")).where(F.col("s").isin(list(sizes)) & (F.pmod(F.xxhash64("node"), F.lit(each)) == 0))
        picked: dict[int, list] = {}
        for r in mine.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("s", "v").collect():
            picked.setdefault(r["s"], []).append(r["v"])
        new = {}
        for s, vectors in sorted(picked.items()):
            c = _centres(sc, vectors, -(-sizes[s] // SHARD))
            if len(c) > 1 or s < 0:
                new[s] = (c, first)
                first += len(c)
        if not new:
            break
        held = ws.save(held.mapInArrow(_assign(sc.broadcast(new), overlap), "node long, many long, v binary, shards array<int>"), f"held-{name}-{k}")
        counts = held.select(F.explode("shards").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LARGE)
        sizes = {r["s"]: r["m"] for r in counts.orderBy(F.desc("m"), "s").limit(MOST_CENTRES // 4).collect()}
        if not sizes:
            break
    return held


def _link(nodes: DataFrame, ws: Workspace, name: str, threshold: float, overlap: int, beam: int) -> DataFrame:
    held = shards(nodes, ws, name, nodes.count(), overlap)
    dealt = held.withColumn("shard", F.explode("shards"))
    lists = dealt.select("shard", "node", "v").groupBy("shard").applyInArrow(_build, "node long, near array<bigint>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    found = ws.save(dealt.join(united, "node").groupBy("shard").applyInArrow(_search(threshold, beam), "kind string, node long, value long"), f"found-{name}")
    return ws.save(_grouped(found, ws), f"linked-{name}")


def _compare(threshold: float):
    """Over the nodes of two blocks p and q: the links between them, counted for either side, and a spanning forest."""

    def run(key, table):
        p, q = (k.as_py() for k in key)
        block, node, many = (table.column(c).to_numpy() for c in ("block", "node", "many"))
        x = _matrix(table.column("v"))
        i, j = np.flatnonzero(block == p), np.flatnonzero(block == q)
        hit = x[i] @ x[j].T >= threshold
        hit &= node[i][:, None] != node[j][None, :]
        label = tie(np.arange(len(node)), *(s[k] for s, k in zip((i, j), np.nonzero(hit), strict=True)))
        for _ in range(64):
            label = label[label]
        tied = label != np.arange(len(node))
        sides = [(node[i], hit @ many[j])] + ([(node[j], hit.T @ many[i])] if p != q else [])
        kinds = ["links"] * sum(len(s[0]) for s in sides) + ["tie"] * int(tied.sum())
        return pa.Table.from_arrays([pa.array(kinds), pa.array(np.concatenate([*(s[0] for s in sides), node[tied]])), pa.array(np.concatenate([*(s[1] for s in sides), node[label[tied]]]).astype(np.int64))], names=["kind", "node", "value"])

    return run


def exact(nodes: DataFrame, ws: Workspace, name: str, n: int, threshold: float) -> DataFrame:
    """(node, links, component_id) by comparing all nodes, two blocks at a time."""
    blocks = -(-n // EXACT_BLOCK)
    own = nodes.select("node", "many", "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = own.select("*", other.alias("o")).select("node", "many", "v", "block", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"))
    found = ws.save(dealt.groupBy("p", "q").applyInArrow(_compare(threshold), "kind string, node long, value long"), f"found-{name}")
    return _grouped(found, ws)
