"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import give_back, lean, saved
from ._text import U, blocks, mixed, text_bytes, words

#: Indicators are hashed to so many columns.
BITS = 19
#: The model is fitted on at most so many labelled rows, those of the smallest hash of their id.
FIT_ROWS = 6000
#: And on as many of them as have so many indicators together, 4 bytes each; these are what the driver gets.
FIT_INDICATORS = 20_000_000
#: Share of the raw weights; the rest is their mean magnitude (the interpolation of the published method).
BETA = 0.25
#: Cost of an error of the class that is rarer is raised to balance the classes.
COST, EPOCHS, SMOOTHING = 1.0, 12, 1.0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, of each hashed indicator
    bias: float
    slope: float  # from the margin to the log odds
    shift: float


#: A word's shape: which of these kinds of bytes it has.
_KIND = np.zeros(256, np.uint8)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[128:] = 8
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 16
_MARKS = np.zeros(256, np.uint64)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = np.random.default_rng(7).integers(1, 2**62, sum(not chr(c).isalnum() for c in range(33, 127)), dtype=np.uint64)


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram indicators of each text, sorted and distinct, and where each text's begin (one more than texts).

    The n-grams are words, pairs of words, and runs of one, two and three word shapes (kinds of bytes and the marks in a word).
    """
    h, first, start, stop = words(column)
    data, _ = text_bytes(column)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edges = np.stack([start, stop], 1).ravel()
    edges = edges[:-1] if edges[-1] == len(data) else edges
    kinds = np.bitwise_or.reduceat(_KIND[data], edges)[::2].astype(np.uint64)
    marks = np.bitwise_or.reduceat(_MARKS[data], edges)[::2]
    long = np.minimum(stop - start, 24).astype(np.uint64) // U(8)
    shape = mixed(kinds * U(0x9E3779B97F4A7C15) ^ marks ^ (long << U(50)))
    same = text[1:] == text[:-1]
    same3 = same[1:] & same[:-1]
    pair = mixed(h[:-1] * U(3) + h[1:] * U(0xC2B2AE3D27D4EB4F))[same]
    shape2 = mixed(shape[:-1] * U(5) + shape[1:] * U(0x165667B19E3779F9))[same]
    shape3 = mixed(shape[:-2] * U(7) + shape[1:-1] * U(11) + shape[2:] * U(0x27D4EB2F165667C5))[same3]
    all_h = np.concatenate([h, pair, shape, shape2, shape3])
    of = np.concatenate([text, text[1:][same], text, text[1:][same], text[2:][same3]])
    key = np.unique((of.astype(np.int64) << BITS) | (all_h >> U(64 - BITS)).astype(np.int64))
    of = key >> BITS
    return key & ((1 << BITS) - 1), np.searchsorted(of, np.arange(len(first)))


def _featurise(batches):
    for batch in batches:
        for part in blocks(batch, "text"):
            got, at = indicators(part.column("text"))
            got = got.astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([got[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())], names=["doc_id", "label", "found"])


def _descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, enough: float = 0.01) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: minimises |w|^2 / 2 + b^2 / 2 + sum cost_i max(0, 1 - y_i (w x_i + b)),
    whose dual variables lie between 0 and cost_i; the bias is a column of ones."""
    w, b = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (float(v @ w[r]) + b) - 1.0
            if (alpha[i] <= 0 and g >= 0) or (alpha[i] >= cost[i] and g <= 0):
                continue
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            d = (new - alpha[i]) * y[i]
            alpha[i] = new
            if d:
                w[r] += d * v
                b += d
                most = max(most, abs(g))
        if most < enough:
            break
    return w, b


def fit(docs: DataFrame, labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most `rows` of labelled (doc_id, label 0 or 1) with FIT_INDICATORS indicators together, stated bounds, in
    the order of the ids' hashes; texts are read whole from docs. Of several rows of an id one takes part.

    Null labels, null ids and labels without a document take no part; of several labels of a document one (the largest) counts.
    With no labels or one class the model is constant. Log-count ratios, weights and the scale of the scores all come
    from these rows; half of them, left out of a first fit, set the scale.
    """
    chosen = labelled.where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    made = some.mapInArrow(lean(_featurise), "doc_id long, label int, found binary")
    one = saved(made.groupBy("doc_id").agg(F.min(F.struct("found", "label")).alias("x")).select("doc_id", "x.label", "x.found"), "indicators")
    upto = F.sum("many").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over `rows` narrow rows at most
    sized = one.select("doc_id", (F.octet_length("found") / 4).cast("long").alias("many")).withColumn("upto", upto)
    few = sized.where(F.col("upto") <= FIT_INDICATORS).select("doc_id")
    got = one.join(F.broadcast(few), "doc_id").toArrow().sort_by("doc_id")
    found = [np.frombuffer(x, np.int32) for x in got.column("found").to_pylist()]
    y = got.column("label").to_numpy().astype(np.float64) * 2 - 1
    if not len(y) or abs(y.sum()) == len(y):
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 3.0 if not len(y) or y[0] > 0 else -3.0)
    half = np.arange(len(y)) % 2 == 0
    if min((y[half] > 0).sum(), (y[half] < 0).sum(), (y[~half] > 0).sum(), (y[~half] < 0).sum()) > 0:
        w, b = _fit(found, y, half)
        margin = np.array([float(w[found[i]].sum()) + b for i in np.flatnonzero(~half)])
        slope, shift = _scale(margin, y[~half] > 0)
    else:
        slope, shift = 2.0, 0.0
    w, b = _fit(found, y, np.ones(len(y), bool))
    return Model(w.astype(np.float32), float(b), slope, shift)


def _fit(found: list[np.ndarray], y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float]:
    count = {}
    for s in (1, -1):
        rows = [found[i] for i in np.flatnonzero(use & (y == s))]
        count[s] = SMOOTHING + np.bincount(np.concatenate(rows), minlength=1 << BITS)
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    seen = (count[1] + count[-1]) > 2 * SMOOTHING
    at = np.flatnonzero(use)
    n_pos, n_neg = (y[at] > 0).sum(), (y[at] < 0).sum()
    cost = np.where(y[at] > 0, len(at) / (2 * n_pos), len(at) / (2 * n_neg)) * COST
    length = np.array([1.0 / np.sqrt(max(1, len(found[i]))) for i in at])
    w, b = _descend([found[i] for i in at], y[at], np.where(seen, ratio, 0.0) * length.mean(), cost)
    w = (1 - BETA) * np.abs(w[seen]).mean() + BETA * w
    return w * np.where(seen, ratio, 0.0) * length.mean(), BETA * b


def _scale(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the class on the margin, by Newton steps, with the targets of Platt's method."""
    n_pos, n_neg = positive.sum(), (~positive).sum()
    t = np.where(positive, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _scores(model, carry: list[str]):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in blocks(batch, "text"):
                got, at = indicators(part.column("text"))
                total = np.concatenate([[0.0], np.cumsum(m.weights[got].astype(np.float64))])
                odds = m.slope * (total[at[1:]] - total[at[:-1]] + m.bias) + m.shift
                score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(score)], names=[*carry, "score"])

    return run


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns in carry and `score` (0 to 1) of every row, repeated ones too. Null text counts as empty, whole texts are
    read; empty texts get the model's score of no indicators. An empty table gives an empty result."""
    give_back()  # of what the fit has used
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).select(*dict.fromkeys([*carry, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in carry)
    return rows.mapInArrow(lean(_scores(shared, carry)), f"{schema}, score double")
