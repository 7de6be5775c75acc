"""Toxicity by non-negative positive-unlabelled learning.

A text is the set of its words (lower-cased runs of digits, letters and all characters beyond ASCII),
hashed. A linear classifier is fitted with numpy on confirmed toxic documents P and on unlabelled text
U, whose share of toxic documents is the class prior. The risk is
``prior * R_P(toxic) + max(0, R_U(clean) - prior * R_P(clean))``; where the second part falls below
zero, a step goes against it instead, so that the classifier can't profit from calling U's toxic
documents clean. Only words that occur in several toxic documents are weighted.

The prior is the toxic share among the labels of the training folds. Fitting uses at most
``positives`` toxic and ``unlabelled`` other documents of the training folds, whose hashed words alone
reach the driver, at most a megabyte each; scoring reads every text whole.

Edge cases: a null or empty text has the classifier's base score; a very long text is a batch of its own; without a toxic document to learn
from, every score is the prior; repeated rows give equal rows; an empty table gives an empty result;
only the id and the text are read for a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_ids, fold
from .textscan import LOWER, U64, pieces, spans, text_bytes, word_hashes

BITS = 18
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[97:123] = NOT_WORD[128:] = False


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed word of each distinct pair."""
    data, off = text_bytes(col)
    low = LOWER[data]
    starts, ends, row = spans(low, off, NOT_WORD)
    key = np.unique(row << BITS | (word_hashes(low, starts, ends) >> U64(64 - BITS)).astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def word_sets(col: pa.Array) -> list[np.ndarray]:
    """The hashed words of each row."""
    row, word = features(col)
    return np.split(word, np.searchsorted(row, np.arange(1, len(col))))


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets).astype(np.int64)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, least: int = 4, decay: float = 1e-4) -> dict:
    """Weights of a linear scorer from the word sets of documents; full-batch Adam on the non-negative risk
    with logistic loss."""
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positive or not unlabelled:
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": base}
    (pr, pw), (ur, uw) = _flat(positive), _flat(unlabelled)
    seen = np.bincount(pw, minlength=1 << BITS)
    # words that are commoner among the toxic, or clearly rarer, than in unlabelled text
    other = np.bincount(uw, minlength=1 << BITS)
    lift = (seen / len(positive)) / np.maximum(other / len(unlabelled), 0.5 / len(unlabelled))
    used = np.flatnonzero((seen >= least) & ((lift > 1.5) | (lift < 0.5)))
    index = np.full(1 << BITS, -1)
    index[used] = np.arange(len(used))
    p, u = index[pw] >= 0, index[uw] >= 0
    pr, pw, ur, uw = pr[p], index[pw[p]], ur[u], index[uw[u]]
    np_, nu = len(positive), len(unlabelled)
    w, bias = np.zeros(len(used) + 1), base
    w[-1] = base
    m, v = np.zeros_like(w), np.zeros_like(w)
    best, best_risk = w.copy(), np.inf
    for t in range(1, steps + 1):
        zp = np.bincount(pr, w[pw], np_) + w[-1]
        zu = np.bincount(ur, w[uw], nu) + w[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        softplus = lambda z: np.logaddexp(0, z)
        toxic_p, clean_p, clean_u = softplus(-zp).mean(), softplus(zp).mean(), softplus(zu).mean()
        negative = clean_u - prior * clean_p
        gp_plus, gp_minus, gu = prior * (sp - 1) / np_, prior * sp / np_, su / nu

        def grad(at_p, at_u):
            g = np.bincount(pw, at_p[pr], len(w)) + np.bincount(uw, at_u[ur], len(w))
            g[-1] = at_p.sum() + at_u.sum()
            return g

        if negative >= 0:
            g = grad(gp_plus - gp_minus, gu) + decay * np.append(w[:-1], 0)
            risk = prior * toxic_p + negative
            if risk < best_risk:
                best, best_risk = w.copy(), risk
        else:
            g = -grad(-gp_minus, gu)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = best[:-1]
    return {"weights": weights, "bias": float(best[-1])}


def scores(col: pa.Array, model: dict) -> np.ndarray:
    row, word = features(col)
    return _sigmoid(np.bincount(row, model["weights"][word], len(col)) + model["bias"])


def _score(model: dict):
    def run(batches):
        for piece in pieces(batches, "text", 2 << 20):
            s = scores(piece.column(2), model)
            yield pa.record_batch([piece.column(0), piece.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def _sets(batches):
    for piece in pieces(batches, "text", 2 << 20):
        words = [x.astype(np.int32).tobytes() for x in word_sets(piece.column(2))]
        yield pa.record_batch([piece.column(0), piece.column(1), pa.array(words, pa.binary())], ["positive", "doc_id", "words"])


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 12000) -> dict:
    """A model from bounded samples of the training folds of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    share = known.agg(F.avg("toxic").alias("p")).first()["p"]
    prior = float(min(max(share if share is not None else 0.05, 1e-3), 0.5))
    toxic = bounded_ids(known.where("toxic = 1"), positives)
    other = sorted(set(bounded_ids(docs.where(fold(F.col("doc_id")) != 0), unlabelled, 1)))
    if not toxic or not other:
        return fit([], [], prior)
    marks = [(i, True) for i in sorted(set(toxic))] + [(i, False) for i in other]
    pick = F.broadcast(docs.sparkSession.createDataFrame(marks, "doc_id long, positive boolean"))
    chosen = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(pick, "doc_id")
    rows = chosen.select("positive", "doc_id", "text").mapInArrow(_sets, "positive boolean, doc_id long, words binary").collect()
    rows = sorted((r["doc_id"], r["positive"], bytes(r["words"])) for r in rows)  # sorted here: a distributed sort would run the scan twice
    sets = [(positive, np.frombuffer(words, np.int32)) for _, positive, words in rows]
    return fit([x for p, x in sets if p], [x for p, x in sets if not p], prior)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
