"""Bounded training samples and small linear models, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a label in the first cut of a sample.
SPREAD = 64


def sample_per_class(rows: DataFrame, label: str, per_class: int, max_classes: int = 256) -> DataFrame:
    """The ``per_class`` rows of each label that come first by a hash of ``doc_id``; ties by id. A label is cut to size
    in ``SPREAD`` parts first, so that no task takes all rows of a frequent one. More than ``max_classes`` labels are
    refused, so the sample is bounded."""
    picked = rows.withColumn("__part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(SPREAD)))
    for keys in ([label, "__part"], [label]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), F.col("doc_id"))
        picked = picked.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= per_class).drop("__place")
    picked = picked.drop("__part")
    n = picked.select(label).distinct().limit(max_classes + 1).count()
    if n > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label}")
    return picked


def one_each(rows: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """``label, doc_id, text`` of the sampled ``ids`` (``label``, ``doc_id``, no pair twice), so never more rows than these:
    of texts that share an id the one of least hash, wherever and however often the id repeats."""
    named = ids.select(F.col("doc_id").alias("__id"), F.col(label).alias("__label"))
    same = F.col("doc_id") == F.col("__id")
    if label in rows.columns:
        same = same & (F.col(label) == F.col("__label"))
    met = rows.join(F.broadcast(named), same).select(F.col("__label").alias(label), "doc_id", "text")
    return met.groupBy(label, "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row is kept from training: by the CRC-32 of its id as text. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(True))


def fit_svm(x: np.ndarray, y: np.ndarray, *, cost: float = 10.0, steps: int = 400) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss; ``y`` is -1 or 1. Both classes
    weigh the same. Accelerated gradient steps of a fixed number, so reruns agree."""
    n, d = x.shape
    ones = np.concatenate([x, np.ones((n, 1), x.dtype)], axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    weight = cost * share
    limit = 1.0 + 2.0 * float((weight * (ones**2).sum(axis=1)).sum())  # of the gradient's slope
    w = np.zeros(d + 1)
    ahead, pace = w.copy(), 1.0
    for _ in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (ones @ ahead))
        grad = ahead * np.append(np.ones(d), 0.0) - 2.0 * ((weight * slack * y) @ ones)
        new = ahead - grad / limit
        faster = (1.0 + (1.0 + 4.0 * pace * pace) ** 0.5) / 2.0
        ahead = new + (pace - 1.0) / faster * (new - w)
        w, pace = new, faster
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (bias last) of a logistic regression by Newton steps; ``y`` is 0 or 1, smoothed as Platt does."""
    good, bad = float((y == 1).sum()), float((y == 0).sum())
    goal = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    ones = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(ones.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(ones @ w, -35, 35)))
        grad = ones.T @ (p - goal) + ridge * w
        curve = (ones * (p * (1 - p))[:, None]).T @ ones + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w = w - step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return w
