"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, so words are labelled first: in a toxic document of
the sample, a word is a toxic token if its type occurs in toxic documents so
much more often than in others that chance doesn't explain it.  A two-state
chain (clean, toxic) is trained on these tokens: emissions from the hashed
identity of a word, its first bytes, the word before and the word after, and
transitions.
Training climbs the conditional likelihood; expectations come from
forward-backward.

Scoring runs forward-backward over every whole text and gives each word the
marginal of the toxic state.  Marginals make the document's evidence, minus
the sum of log(1 - marginal), which a logistic curve, fitted on a quarter of
the sample that the chain didn't see, turns into a probability.  Words whose
marginal reaches one half are returned as spans (byte offsets).

Words are compared without ASCII punctuation at their ends and with A-Z
lowered.  The sample has at most ``SAMPLE`` labelled documents and
``SAMPLE_BYTES`` of text and is gathered in one training task; the model is a megabyte and is broadcast.  Empty and null
texts have no evidence and get the curve's probability for none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import held_out, logistic, probability, sample
from .workspace import Workspace

U64 = np.uint64
SAMPLE, SAMPLE_BYTES = 8192, 32 << 20
BITS = 16
SLICE_BYTES = 4 << 20
EPOCHS, RATE, RIDGE = 4, 0.5, 1e-6
SPAN = 0.5
_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
UNITS = (None, 4, 6)  # a word whole, and its first bytes: insults come with many endings
KINDS = len(UNITS) + 2
FLOOR = 1e-6  # evidence of a text without toxic words
LONG = 1024  # texts of more words are passed through in chunks that run side by side


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the bare words, their starts and ends, and the rows' word offsets."""
    starts, ends, at = W.word_spans(data, offsets)
    s, e = starts.copy(), ends.copy()
    for _ in range(4):
        s += _PUNCT[data[s]] & (e - s > 1) if len(s) else 0
    for _ in range(4):
        e -= _PUNCT[data[e - 1]] & (e - s > 1) if len(e) else 0
    units = [W.word_hashes(data, s, e if n is None else np.minimum(e, s + n), fold=True) for n in UNITS]
    return np.stack(units, axis=1), s, e, at


def features(units: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places per word: its units, the word before, the word after."""
    h = units[:, 0]
    before, after = np.zeros_like(h), np.zeros_like(h)
    before[1:], after[:-1] = h[:-1], h[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    before[edge] = 0
    after[at[1:][at[:-1] < at[1:]] - 1] = 0
    top = U64(64 - BITS)
    kinds = [*units.T, W.mix(before + U64(11)), W.mix(after + U64(23))]
    return np.stack([(x >> top) + U64(k << BITS) for k, x in enumerate(kinds)], axis=1).astype(np.int32)


def _grouped(lens: np.ndarray):
    """Rows of like length together, so that padding at most doubles the work; long ones alone."""
    size = np.where((lens > 0) & (lens <= LONG), np.ceil(np.log2(np.maximum(lens, 1))).astype(int), -1)
    for k in np.unique(size[size >= 0]):
        yield np.flatnonzero(size == k)
    yield from np.flatnonzero(lens > LONG)[:, None]


def _fractions(a: np.ndarray, b: np.ndarray | float, c: np.ndarray, d: float, v: float) -> np.ndarray:
    """v = (a[i] v + b[i]) / (c[i] v + d[i]) for each i in turn.

    Such steps compose like 2 x 2 matrices: the products of chunks are taken side by side, give the value at the
    start of each chunk, and then all chunks are gone through again at once; so n steps take 3 sqrt(n) rounds.
    """
    n = len(a)
    size = int(np.ceil(np.sqrt(n)))
    m = -(-n // size)
    lay = lambda x, pad: np.concatenate([np.broadcast_to(x, n), np.full(size * m - n, pad)]).reshape(m, size).T
    a, b, c, d = lay(a, 1.0), lay(b, 0.0), lay(c, 0.0), lay(d, 1.0)
    p, q, r, s = np.ones(m), np.zeros(m), np.zeros(m), np.ones(m)
    for i in range(size):
        p, q, r, s = a[i] * p + b[i] * r, a[i] * q + b[i] * s, c[i] * p + d[i] * r, c[i] * q + d[i] * s
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / top, q / top, r / top, s / top
    now = np.empty(m)
    for k in range(m):
        now[k] = v
        v = (p[k] * v + q[k]) / (r[k] * v + s[k])
    out = np.empty((size, m))
    for i in range(size):
        now = (a[i] * now + b[i]) / (c[i] * now + d[i])
        out[i] = now
    return out.T.ravel()[:n]


class Chain:
    """exp of the transition scores as a 2 x 2 array, and emission weights over places."""

    def __init__(self, weights: np.ndarray, bias: float, log_t: np.ndarray):
        self.weights, self.bias, self.log_t = weights, bias, log_t

    def emissions(self, f: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[f].sum(1) + self.bias, -30, 30)

    def marginals(self, e: np.ndarray, at: np.ndarray, expect: bool = False):
        """P(toxic) of every word; with expect, also the expected numbers of each transition."""
        t = np.exp(self.log_t)
        lens, out, pairs = np.diff(at), np.zeros(len(e)), np.zeros((2, 2))
        for rows in _grouped(lens):
            n, m = int(lens[rows].max()), len(rows)
            index = at[rows][None, :] + np.arange(n)[:, None]
            inside = np.arange(n)[:, None] < lens[rows][None, :]
            x = np.exp(np.where(inside, e[np.minimum(index, len(e) - 1)], 0.0))
            r, b = np.empty((n, m)), np.ones((n, m))
            r[0] = x[0]
            if n > LONG:  # one row
                y = x[1:, 0]
                r[1:, 0] = _fractions(y * t[1, 1], y * t[0, 1], np.full(n - 1, t[1, 0]), t[0, 0], float(x[0, 0]))
                y = y[::-1]
                b[:-1, 0] = _fractions(y * t[1, 1], t[1, 0], y * t[0, 1], t[0, 0], 1.0)[::-1]
            else:
                for i in range(1, n):
                    r[i] = x[i] * (t[0, 1] + r[i - 1] * t[1, 1]) / (t[0, 0] + r[i - 1] * t[1, 0])
                for i in range(n - 2, -1, -1):
                    y = x[i + 1] * b[i + 1]
                    b[i] = np.where(inside[i + 1], (t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y), 1.0)
            odds = r * b
            out[index[inside]] = (odds / (1 + odds))[inside]
            if expect and n > 1:
                y, q, ok = (x * b)[1:], r[:-1], inside[1:]
                joint = np.stack([np.full_like(y, t[0, 0]), t[0, 1] * y, q * t[1, 0], q * t[1, 1] * y])
                joint = np.where(ok, joint / joint.sum(0), 0.0)
                pairs += joint.sum((1, 2)).reshape(2, 2)
        return (out, pairs) if expect else out


def label_tokens(units: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for words of toxic rows of which a unit is significantly more frequent, by documents, in toxic rows.

    A whole word may also occur elsewhere; a beginning, which many words share, must nearly always be toxic.
    """
    row, bad = W.row_of(at), np.zeros(len(units), bool)
    for k, share_needed in zip(range(units.shape[1]), (0.4, *[0.8] * (len(UNITS) - 1)), strict=True):
        types, which = np.unique(units[:, k], return_inverse=True)
        once = np.unique(which * len(y) + row)
        kind, doc = once // len(y), once % len(y)
        toxic = np.bincount(kind, weights=y[doc], minlength=len(types))
        every = np.bincount(kind, minlength=len(types))
        share = (y.sum() + 1) / (len(y) + 2)
        z = (toxic - every * share) / np.sqrt(every * share * (1 - share) + 1e-9)
        bad |= ((toxic >= 4) & (z > 6) & (toxic > share_needed * every))[which]
    return (bad & (y[row] == 1)).astype(np.float64)


def train(units: np.ndarray, at: np.ndarray, gold: np.ndarray, seed: int = 0) -> Chain:
    """Adaptive gradient ascent of the conditional log-likelihood."""
    f, rows = features(units, at), np.flatnonzero(np.diff(at) > 0)
    chain = Chain(np.zeros(KINDS << BITS), -4.0, np.zeros((2, 2)))
    sums, sum_b, sum_t = np.full(KINDS << BITS, 1e-2), 1.0, np.ones((2, 2))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 128)):
            lens = np.diff(at)[part]
            own = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
            index = np.concatenate([np.arange(at[i], at[i + 1]) for i in part])
            g, ff = gold[index], f[index]
            p, pairs = chain.marginals(chain.emissions(ff), own, expect=True)
            inner = np.ones(len(g), bool)
            inner[own[:-1]] = False
            now = g[inner].astype(int)
            then = g[np.flatnonzero(inner) - 1].astype(int)
            seen = np.bincount(then * 2 + now, minlength=4).reshape(2, 2)
            grad = np.bincount(ff.ravel(), weights=np.repeat(g - p, KINDS), minlength=KINDS << BITS) - RIDGE * chain.weights
            sums += grad * grad
            chain.weights = chain.weights + RATE * grad / np.sqrt(sums)
            gb = (g - p).sum()
            sum_b += gb * gb
            chain.bias += RATE * gb / np.sqrt(sum_b)
            gt = seen - pairs
            sum_t += gt * gt
            chain.log_t = np.clip(chain.log_t + 0.1 * gt / np.sqrt(sum_t), -4, 4)
    return chain


def evidence(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log of minus the sum of log(1 - p) over each row's words, and FLOOR."""
    total = np.r_[0, np.cumsum(-np.log1p(-np.minimum(p, 1 - 1e-9)))]
    return np.log(np.maximum(total[at[1:]] - total[at[:-1]], 0) + FLOOR)


def _hash_sample(batches):
    for batch in batches:
        for piece in W.slices(batch, "text", SLICE_BYTES):
            h, _, _, at = tokens(*W.text_bytes(piece.column("text")))
            x = [W.pack(h[i:j].ravel()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])


def _train(batches):
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["y"] != 0 for r in rows], np.int64)
    texts = [W.unpack(r["x"]).reshape(-1, len(UNITS)) for r in rows]
    rows.clear()
    check = np.arange(len(y)) % 4 == 3

    def flat(keep):
        own = [t for t, k in zip(texts, keep, strict=True) if k]
        return np.concatenate([np.zeros((0, len(UNITS)), U64), *own]), np.cumsum([0, *map(len, own)])

    if len(set(y[~check])) < 2 or len(set(y[check])) < 2:
        chain, line = Chain(np.zeros(KINDS << BITS), -30.0, np.zeros((2, 2))), np.array([0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    else:
        h, at = flat(~check)
        chain = train(h, at, label_tokens(h, at, y[~check]))
        h, at = flat(check)
        line = logistic(evidence(chain.marginals(chain.emissions(features(h, at)), at), at)[:, None], y[check].astype(float))
    out = {"weights": chain.weights.astype(np.float32).tobytes(), "rest": [chain.bias, *chain.log_t.ravel(), *line]}
    yield pa.RecordBatch.from_pylist([out], schema=pa.schema([("weights", pa.binary()), ("rest", pa.list_(pa.float64()))]))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[Chain, np.ndarray]:
    rows = sample(docs, labels, "toxic", mod, rest, most, most_bytes, Workspace(docs.sparkSession, "toxicity")).mapInArrow(_hash_sample, "doc_id long, y int, x binary")
    model = rows.repartition(1).mapInArrow(_train, "weights binary, rest array<double>").first()
    more = np.array(model["rest"])
    return Chain(np.frombuffer(bytes(model["weights"]), np.float32), float(more[0]), more[1:5].reshape(2, 2)), more[5:]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def judge(model, column: pa.Array) -> tuple[np.ndarray, list]:
    """Probabilities and spans of the texts of a column."""
    chain, line = model
    data, offsets = W.text_bytes(column)
    h, s, e, at = tokens(data, offsets)
    p = chain.marginals(chain.emissions(features(h, at)), at) if len(h) else np.zeros(0)
    score = probability(line, evidence(p, at)[:, None])
    spans: list = [[] for _ in range(len(column))]
    row = W.row_of(at)
    for i in np.flatnonzero(p >= SPAN):
        spans[row[i]].append({"start": int(s[i] - offsets[row[i]]), "end": int(e[i] - offsets[row[i]]), "marginal": float(p[i])})
    return score, spans


def _score(model, mod: int, rest: int, threshold: float):
    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                p, spans = judge(model.value, piece.column("text"))
                ids = piece.column("doc_id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(held_out(ids.to_pylist(), mod, rest)), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(spans, _SPANS)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return run


RESULT = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:bigint,end:bigint,marginal:double>>"


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """A row for each of docs (doc_id, text), learned from labels (doc_id, toxic); spans are byte offsets in the text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, mod, rest, most))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(model, mod, rest, threshold), RESULT)


def remove_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """docs without the rows whose score reaches the threshold, all columns kept, in one narrow pass.

    Each row is judged by its text alone: repeated rows stay or go together, null texts count as empty, null
    doc_ids are never learned from.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(train_docs, labels, mod, rest, most))

    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                yield piece.filter(pa.array(judge(model.value, piece.column("text"))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
