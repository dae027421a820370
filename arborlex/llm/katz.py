"""Katz backoff language model (bigrams over unigrams), trained and evaluated without a global dictionary.

Documents are cut into *tiles* (runs of documents of some megabytes of text).
A tile keeps its tokens as numbers of its own small vocabulary.

1. Unigrams.  Each tile sends its distinct word hashes with training counts to
   hash buckets; a bucket adds them up, numbers its words by falling count and
   answers each tile with numbers and counts.
2. Bigrams.  Each tile sends its distinct (history, word) pairs to buckets; a
   bucket adds them up and answers with c(history, word) and, for a history,
   how many of its followers were seen 1..k times and the unigram mass of its
   followers.  A history that alone is more than a bucket's share is dealt over
   several buckets by its followers; its sums are added up by an aggregation
   and joined to the tiles that have it.
3. Each tile evaluates its tokens by the recursion
   P(w|h) = d(c(hw)) c(hw) / c(h) if c(hw) > 0, else alpha(h) P(w),
   P(w) = d(c(w)) c(w) / N if c(w) > 0, else the mass that discounts left.

Discounts are Good-Turing for counts up to k = 5.  alpha(h) is normalised
exactly from the sums in 2, so P(.|h) adds up to 1 over the vocabulary and the
class of unknown words.  A history all of whose followers are frequent frees no
mass; there, one more event is added to c(h) and its share is what is left.  The counts are kept in tables partitioned by order
(``ngrams/kind=unigrams|bigrams``), packed by bucket.

Words are known by 64-bit hashes of their bytes.  Null texts are empty; a null
doc_id counts as the empty text for the training split.  Repeated rows are
scored, and learned from, as often as they come.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .workspace import Workspace, buckets_for

U64 = np.uint64
END = U64(1)  # the hash of the end token; words have hashes that are as good as random
K = 5  # counts above are not discounted
TILE_BYTES = 8 << 20
UNI_EACH, BI_EACH = 400_000, 600_000  # entries in a bucket, about

TILE = "tile long, doc_ids array<bigint>, lens binary, tokens binary, vocab binary, counts binary, n_vocab long, n_tokens long"
PART = "kind string, tile long, part long, a binary, b binary, c binary, stats array<bigint>, mass double"
NOTHING = dict.fromkeys("abc")


def training(doc_ids: list, mod: int, rest: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % mod != rest for x in doc_ids], dtype=bool)


def _tiles(mod: int, rest: int):
    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in W.slices(batch, "text", TILE_BYTES):
                data, offsets = W.text_bytes(piece.column("text"))
                starts, ends, at = W.word_spans(data, offsets)
                hashes = W.word_hashes(data, starts, ends, fold=True)
                lens = np.diff(at) + 1
                tokens = np.insert(hashes, at[1:], END)
                vocab, local = np.unique(tokens, return_inverse=True)
                ids = piece.column("doc_id").to_pylist()
                seen = np.repeat(training(ids, mod, rest), lens)
                counts = np.bincount(local[seen], minlength=len(vocab))
                row = {"tile": [(part << 32) + k], "doc_ids": [ids], "lens": [W.pack(W.small(lens))], "tokens": [W.pack(W.small(local))], "vocab": [W.pack_sorted(vocab)], "counts": [W.pack(W.small(counts))], "n_vocab": [len(vocab)], "n_tokens": [len(tokens)]}
                k += 1
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("tile", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("lens", "tokens", "vocab", "counts")), ("n_vocab", pa.int64()), ("n_tokens", pa.int64())]))

    return run


_ASK = pa.schema([("bucket", pa.int64()), ("tile", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
ASK = "bucket long, tile long, a binary, b binary, c binary"
_PART = pa.schema([("kind", pa.string()), ("tile", pa.int64()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("stats", pa.list_(pa.int64())), ("mass", pa.float64())])


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist([dict.fromkeys(schema.names) | r for r in rows], schema=schema)


def _bits(n_buckets: int) -> int:
    return n_buckets.bit_length() - 1


def _bucket(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """The leading bits of a hash."""
    return (h >> U64(1) >> U64(63 - _bits(n_buckets))).astype(np.int64)


def _ask_unigrams(n_buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocab, counts = W.unpack_sorted(row["vocab"]), W.unpack(row["counts"])
                b = _bucket(vocab, n_buckets)
                cut = np.flatnonzero(np.diff(b, prepend=-1))
                for i, j in zip(cut, [*cut[1:], len(b)], strict=True):
                    yield pa.RecordBatch.from_pylist([{"bucket": int(b[i]), "tile": row["tile"], "a": W.pack_sorted(vocab[i:j]), "b": W.pack(W.small(counts[i:j])), "c": None}], schema=_ASK)

    return run


def _count_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(c[(c > 0) & (c <= K + 1)], minlength=K + 2)[1:].tolist()


def _answer_unigrams(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        bucket = asked[0]["bucket"]
        hashes = [W.unpack_sorted(r["a"]) for r in asked]
        own, where = np.unique(np.concatenate(hashes), return_inverse=True)
        count = np.bincount(where, weights=np.concatenate([W.unpack(r["b"]) for r in asked])).astype(np.int64)
        rank = np.empty(len(own), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(own))
        number = np.where(count > 0, rank * n_buckets + bucket + 1, 0)
        out, at = [], 0
        for r, h in zip(asked, hashes, strict=True):
            i = where[at : at + len(h)]
            at += len(h)
            out.append({"kind": "uni", "tile": r["tile"], "part": bucket, "a": W.pack(W.small(number[i])), "b": W.pack(W.small(count[i]))})
        seen = count > 0
        out.append({"kind": "unigrams", "tile": -1, "part": bucket, "a": W.pack_sorted(own[seen]), "b": W.pack(W.small(count[seen])), "stats": [int(count.sum()), int(seen.sum()), *_count_of_counts(count)]})
        return _rows(out, _PART)

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount factors d[0..K] from the numbers of n-grams seen 1..K+1 times.

    A count whose estimate isn't in (0, 1) takes the absolute discount n1/(n1+2 n2) instead,
    so that some mass is left for what wasn't seen.
    """
    d = np.ones(K + 1)
    n1, n2 = n[0], n[1]
    flat = n1 / (n1 + 2 * n2) if n1 else 0.5
    tail = (K + 1) * n[K] / n1 if n1 else 1.0
    for r in range(1, K + 1):
        good = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        x = (good - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = x if 0 < x < 1 else 1 - min(flat, 0.999) / r
    return d


@dataclass(frozen=True)
class Unigrams:
    total: int
    distinct: int
    n_docs: int  # training documents, the count of the begin-of-text history
    d: tuple

    def unknown(self) -> float:
        """The mass of unknown words: what the discounts leave, and no less than add-one would."""
        return max(self.left, 1.0 / (self.total + self.distinct + 1)) if self.total else 1.0

    left: float = 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        """P(w) by count; 0 stands for the class of unknown words."""
        if not self.total:
            return np.ones(len(c))
        d = np.asarray(self.d)
        kept = (1 - self.unknown()) / (1 - self.left)
        return np.where(c > 0, d[np.where(c <= K, c, 0)] * c / self.total * kept, self.unknown())


def unigram_model(total: int, distinct: int, n_docs: int, n: list[int]) -> Unigrams:
    d = discounts(n)
    left = sum((1 - d[r]) * r * n[r - 1] for r in range(1, K + 1)) / total if total else 0.0
    return Unigrams(total, distinct, n_docs, tuple(d), left)


class _Tile:
    """A tile with the unigrams' answers: pairs of the tile, sorted by bucket, history and word."""

    def __init__(self, rows: list[dict], uni: Unigrams, n_buckets: int, mod: int, rest: int):
        state = next(r for r in rows if r["kind"] == "tile")
        answers = sorted((r for r in rows if r["kind"] == "uni"), key=lambda r: r["part"])
        self.doc_ids, self.lens = state["doc_ids"], W.unpack(state["a"]).astype(np.int64)
        local = W.unpack(state["b"]).astype(np.int64)
        self.number = np.concatenate([W.unpack(r["a"]).astype(np.int64) for r in answers])
        self.count = np.concatenate([W.unpack(r["b"]).astype(np.int64) for r in answers])
        self.at = np.cumsum(np.r_[0, self.lens])
        self.train = training(self.doc_ids, mod, rest)
        self.local, nv = local, len(self.number)
        history = np.empty_like(local)
        history[1:] = local[:-1]
        history[self.at[:-1]] = nv  # begin of text
        known = np.r_[self.count > 0, True]
        word = np.where(self.count[local] > 0, local, nv)  # nv: unknown
        self.ask = known[history]
        pair = history[self.ask] * (nv + 1) + word[self.ask]
        own, which = np.unique(pair, return_inverse=True)
        in_training = np.repeat(self.train, self.lens)[self.ask]
        seen = np.bincount(which[in_training], minlength=len(own))
        h, w = own // (nv + 1), own % (nv + 1)
        numbers, counts = np.r_[self.number, 0], np.r_[self.count, uni.n_docs]
        self.h, ch = numbers[h], counts[h]
        self.w = numbers[w]
        cw = np.r_[self.count, 0][w]
        parts = np.minimum(n_buckets, 1 + ch * n_buckets // max(1, uni.total))
        self.hot = parts > 1
        salt = (W.mix(self.w.astype(U64)) % parts.astype(U64)).astype(U64)
        bucket = _bucket(W.mix(self.h.astype(U64) * U64(0x9E3779B97F4A7C15) + salt), n_buckets)
        order = np.lexsort((self.w, self.h, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.which = place[which]  # of each position that asks, its pair
        self.h, self.w, self.ch, self.cw, self.seen, self.hot, self.bucket = (x[order] for x in (self.h, self.w, ch, cw, seen, self.hot, bucket))

    def cuts(self):
        cut = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        return zip(cut, [*cut[1:], len(self.bucket)], strict=True)


def _runs(bucket_h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(bucket_h, prepend=-1))


def _ask_bigrams(uni: Unigrams, n_buckets: int, mod: int, rest: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        t = _Tile(rows, uni, n_buckets, mod, rest)
        out, hot = [], np.unique(t.h[t.hot])
        if len(hot):  # which hot histories the tile has, by way of a bucket of its own
            out.append({"bucket": -1 - rows[0]["tile"], "tile": rows[0]["tile"], "a": W.pack(hot)})
        for i, j in t.cuts():
            runs = _runs(t.h[i:j])
            pairs = [W.pack(W.small(np.diff(t.h[i:j][runs], prepend=0))), W.pack(W.small(np.diff(np.r_[runs, j - i]))), W.pack(W.small(t.w[i:j]))]
            sums = [W.pack(t.hot[i:j][runs].astype(np.uint8)), W.pack(W.small(t.cw[i:j])), W.pack(W.small(t.seen[i:j]))]
            out.append({"bucket": int(t.bucket[i]), "tile": rows[0]["tile"], "a": _join(pairs), "b": _join(sums), "c": None})
        return _rows(out, _ASK)

    return run


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _split(b: bytes) -> list[np.ndarray]:
    out, i = [], 0
    while i < len(b):
        n = int.from_bytes(b[i : i + 4], "little")
        out.append(W.unpack(b[i + 4 : i + 4 + n]))
        i += 4 + n
    return out


def _answer_bigrams(uni: Unigrams):
    def run(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        bucket = asked[0]["bucket"]
        if bucket < 0:
            return _rows([{"kind": "asks", "tile": r["tile"], "part": int(h)} for r in asked for h in W.unpack(r["a"])], _PART)
        hs, ws, cws, seens, hots, sizes = [], [], [], [], [], []
        for r in asked:
            dh, many, w = _split(r["a"])
            hot, cw, seen = _split(r["b"])
            h = np.repeat(np.cumsum(dh.astype(np.int64)), many)
            hs.append(h)
            ws.append(w.astype(np.int64))
            cws.append(cw)
            seens.append(seen)
            hots.append(np.repeat(hot, many))
            sizes.append(len(h))
        h, w = np.concatenate(hs), np.concatenate(ws)
        hs.clear(), ws.clear()
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
        first = np.flatnonzero(new)
        count = np.add.reduceat(np.concatenate(seens).astype(np.int64)[order], first)
        cw, hot = np.concatenate(cws)[order][first].astype(np.int64), np.concatenate(hots)[order][first]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        uh, uw = h[first], w[first]
        runs = _runs(uh)
        mass = np.add.reduceat(np.where(count > 0, uni.p(cw), 0.0), runs)
        m = np.stack([np.add.reduceat((count == r).astype(np.int64), runs) for r in range(1, K + 1)], axis=1)
        run_of = np.cumsum(np.diff(uh, prepend=-1) != 0) - 1
        out, at = [], 0
        for r, n in zip(asked, sizes, strict=True):
            i = back[at : at + n]
            at += n
            own = run_of[i[_runs(uh[i])]]
            out.append({"kind": "bi", "tile": r["tile"], "part": bucket, "a": W.pack(W.small(count[i])), "b": W.pack(W.small(m[own].ravel())), "c": W.pack(mass[own])})
        for x in np.flatnonzero(hot[runs]):
            out.append({"kind": "hot", "tile": -1, "part": int(uh[runs[x]]), "mass": float(mass[x]), "stats": m[x].tolist()})
        seen = count > 0
        out.append({"kind": "bigrams", "tile": -1, "part": bucket, "a": _join([W.pack(W.small(np.diff(uh[seen], prepend=0))), W.pack(W.small(uw[seen]))]), "b": W.pack(W.small(count[seen])), "stats": [int(count.sum()), int(seen.sum()), *_count_of_counts(count)]})
        return _rows(out, _PART)

    return run


def _score(uni: Unigrams, d2: np.ndarray, n_buckets: int, mod: int, rest: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        t = _Tile(rows, uni, n_buckets, mod, rest)
        answers = {r["part"]: r for r in rows if r["kind"] == "bi"}
        hot = {r["part"]: (r["stats"], r["mass"]) for r in rows if r["kind"] == "hot"}
        count, alpha, scale = np.zeros(len(t.h), np.int64), np.ones(len(t.h)), np.ones(len(t.h))
        for i, j in t.cuts():
            r = answers[int(t.bucket[i])]
            count[i:j] = W.unpack(r["a"])
            runs = _runs(t.h[i:j])
            m, mass = W.unpack(r["b"]).astype(np.int64).reshape(-1, K), W.unpack(r["c"]).copy()
            hs, ch, is_hot = t.h[i:j][runs], t.ch[i:j][runs], t.hot[i:j][runs]
            for x in np.flatnonzero(is_hot):
                m[x], mass[x] = hot[int(hs[x])]
            freed = (m * (np.arange(1, K + 1) * (1 - d2[1:]))).sum(1) / np.maximum(ch, 1)
            kept = np.where(freed > 0, 1.0, ch / (ch + 1.0))
            many = np.diff(np.r_[runs, j - i])
            alpha[i:j] = np.repeat(np.where(freed > 0, freed, 1 / (ch + 1.0)) / (1 - mass), many)
            scale[i:j] = np.repeat(kept, many)
        p = uni.p(t.count[t.local])
        c = count[t.which]
        backed = alpha[t.which] * p[t.ask]
        p[t.ask] = np.where(c > 0, d2[np.where(c <= K, c, 0)] * c * scale[t.which] / np.maximum(t.ch[t.which], 1), backed)
        c1 = t.count[t.local]
        base = np.log10((c1 + 1) / (uni.total + uni.distinct + 1))
        total = lambda x: np.add.reduceat(x, t.at[:-1])  # noqa: E731  every text has its end token
        n = len(t.doc_ids)
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip((t.doc_ids, ~t.train, t.lens, total((c1 > 0).astype(np.int64)), np.full(n, uni.total), total(base), total(np.log10(p))), kinds, strict=True)], names=names)

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """Trains on the texts whose crc32(doc_id) mod ``mod`` isn't ``rest`` and scores all; see the module.

    ``docs`` needs doc_id and text; other columns are ignored.  One row per input row.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "katz")
    tiles = ws.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tiles(mod, rest), TILE), "tiles")
    size = tiles.agg(F.coalesce(F.sum("n_vocab"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    if not size[1]:
        return spark.createDataFrame([], RESULT)
    b1, b2 = buckets_for(size[0], UNI_EACH), buckets_for(size[1], BI_EACH)
    asked = tiles.select("tile", "vocab", "counts").mapInArrow(_ask_unigrams(b1), ASK)
    uni_parts = ws.save(asked.groupBy("bucket").applyInArrow(_answer_unigrams(b1), PART), "unigrams", "kind")
    stats = _stats(uni_parts, "unigrams")
    ids = F.explode("doc_ids").alias("d")
    crc = F.crc32(F.coalesce(F.col("d").cast("string"), F.lit("")).cast("binary"))
    n_docs = tiles.select(ids).where(crc % mod != rest).count()
    uni = unigram_model(stats[0], stats[1], n_docs, stats[2:])
    blank = F.lit(None).cast("binary")
    state = tiles.select(F.lit("tile").alias("kind"), "tile", F.lit(-1).cast("long").alias("part"), F.col("lens").alias("a"), F.col("tokens").alias("b"), blank.alias("c"), "doc_ids")
    answer = lambda df, kind: df.where(F.col("kind") == kind).select("kind", "tile", F.col("part").cast("long").alias("part"), "a", "b", "c", F.lit(None).cast("array<bigint>").alias("doc_ids"))
    first = state.unionByName(answer(uni_parts, "uni"))
    pairs = first.groupBy("tile").applyInArrow(_ask_bigrams(uni, b2, mod, rest), ASK)
    bi_parts = ws.save(pairs.groupBy("bucket").applyInArrow(_answer_bigrams(uni), PART), "bigrams", "kind")
    d2 = discounts(_stats(bi_parts, "bigrams")[2:])
    sums = (F.sum(F.col("stats")[i]).alias(f"m{i}") for i in range(K))
    hot = bi_parts.where("kind = 'hot'").select(F.col("part").cast("long").alias("part"), "stats", "mass").groupBy("part").agg(*sums, F.sum("mass").alias("mass"))
    asks = bi_parts.where("kind = 'asks'").select("tile", F.col("part").cast("long").alias("part"))
    told = asks.join(hot, "part").select(F.lit("hot").alias("kind"), "tile", "part", F.array(*(f"m{i}" for i in range(K))).alias("stats"), "mass")
    nothing = {"stats": F.lit(None).cast("array<bigint>"), "mass": F.lit(None).cast("double")}
    both = first.unionByName(answer(bi_parts, "bi")).withColumns(nothing).unionByName(told, allowMissingColumns=True)
    return both.groupBy("tile").applyInArrow(_score(uni, d2, b2, mod, rest), RESULT)


def _stats(parts: DataFrame, kind: str) -> list[int]:
    n = 2 + K + 1
    row = parts.where(F.col("kind") == kind).agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(n))).first()
    return [int(x) for x in row]
