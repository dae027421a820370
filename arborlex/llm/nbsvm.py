"""Quality classifier: a support vector machine over n-gram indicators scaled by class log-count ratios.

Features are indicators of the text's byte trigrams (which cross word
boundaries and keep case), hashed to 2**17 places.  An indicator is scaled by
the naive-Bayes log-count ratio of its place, and a text's vector is divided
by the root of its number of indicators.  A linear hinge-loss model is fitted
by dual coordinate descent on three quarters of the sample; the other quarter
calibrates its margins to probabilities.

The sample has at most ``SAMPLE`` labelled documents and ``SAMPLE_BYTES`` of text, gathered in one training
task; the fitted model is half a megabyte and is broadcast.  Every text is
scored whole.  Texts of fewer than three bytes (empty and null ones too) have
no trigram and get the probability of margin 0.  If one class is missing from
the sample, every score is the add-one share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import held_out, logistic, probability, sample
from .workspace import Workspace

SAMPLE, SAMPLE_BYTES = 8192, 32 << 20
BITS = 17
SLICE_BYTES = 4 << 20
C, EPOCHS, ENOUGH = 1.0, 40, 0.02


def indicators(data: np.ndarray, offsets: np.ndarray):
    """For each row the sorted distinct places of its trigrams."""
    if len(data) < 3:
        for _ in range(len(offsets) - 1):
            yield np.zeros(0, np.int64)
        return
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    place = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    seen = np.zeros(1 << BITS, bool)
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = place[i : max(i, j - 2)]
        if len(own) < 1 << 14:
            yield np.unique(own).astype(np.int64)
        else:
            seen[own] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


def _featurise(batches):
    for batch in batches:
        for piece in W.slices(batch, "text", SLICE_BYTES):
            x = [W.pack(f.astype(np.uint32)) for f in indicators(*W.text_bytes(piece.column("text")))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])


def log_count_ratio(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(f for f, own in zip(x, y, strict=True) if own == c)]).astype(np.int64), minlength=1 << BITS) + 1.0 for c in (0, 1)]
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


@dataclass
class Dual:
    """The state of the descent: primal weights over scaled indicators, dual variables, their upper bounds."""

    w: np.ndarray
    alpha: np.ndarray
    upper: np.ndarray


def descend(x: list[np.ndarray], y: np.ndarray, r: np.ndarray, seed: int = 0, epochs: int = EPOCHS, enough: float = ENOUGH) -> Dual:
    """Minimises |w|^2/2 + the sum of C times the hinge losses by dual coordinates; C is weighted so that both classes count alike.

    Ends after ``epochs``, or when no coordinate breaks its optimality condition by more than ``enough``.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([C * len(y) / (2 * max(1, (y == 0).sum())), C * len(y) / (2 * max(1, (y == 1).sum()))])
    upper = share[y]
    w, alpha = np.zeros(1 << BITS), np.zeros(len(y))
    scaled = [r[f] / np.sqrt(max(1, len(f))) for f in x]
    norm = np.array([(v * v).sum() for v in scaled])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            if norm[i] > 0:
                gradient = sign[i] * (w[x[i]] @ scaled[i]) - 1
                new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
                if new != alpha[i]:
                    worst = max(worst, abs(gradient))
                    w[x[i]] += (new - alpha[i]) * sign[i] * scaled[i]
                    alpha[i] = new
        if worst <= enough:
            break
    return Dual(w, alpha, upper)


def margin(weights: np.ndarray, f: np.ndarray) -> float:
    return float(weights[f].sum() / np.sqrt(len(f))) if len(f) else 0.0


def _train(batches):
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["x"]))
    x, y = [W.unpack(r["x"]).astype(np.int64) for r in rows], np.array([r["y"] for r in rows], np.int64)
    y = (y != 0).astype(np.int64)
    check = np.arange(len(y)) % 4 == 3
    if len(set(y[~check])) < 2 or len(set(y[check])) < 2:
        w, line = np.zeros(1 << BITS), np.array([0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    else:
        fit = [f for f, c in zip(x, check, strict=True) if not c]
        r = log_count_ratio(fit, y[~check])
        w = descend(fit, y[~check], r).w * r
        line = logistic(np.array([[margin(w, f)] for f, c in zip(x, check, strict=True) if c]), y[check].astype(float))
    yield pa.RecordBatch.from_pylist([{"weights": w.astype(np.float32).tobytes(), "line": line.tolist()}], schema=pa.schema([("weights", pa.binary()), ("line", pa.list_(pa.float64()))]))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The weights and the calibration, learned from rows whose crc32(doc_id) mod ``mod`` isn't ``rest``."""
    rows = sample(docs, labels, "quality", mod, rest, most, most_bytes, Workspace(docs.sparkSession, "quality")).mapInArrow(_featurise, "doc_id long, y int, x binary")
    model = rows.repartition(1).mapInArrow(_train, "weights binary, line array<double>").first()
    return np.frombuffer(bytes(model["weights"]), np.float32), np.array(model["line"])


def _score(model, mod: int, rest: int, threshold: float):
    def run(batches):
        weights, line = model.value
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                m = np.array([[margin(weights, f)] for f in indicators(*W.text_bytes(piece.column("text")))])
                p = probability(line, m)
                ids = piece.column("doc_id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(held_out(ids.to_pylist(), mod, rest)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each of docs; docs has doc_id and text, labels doc_id and quality."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, mod, rest, most))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(model, mod, rest, threshold), "doc_id long, held_out boolean, score double, predicted int")
