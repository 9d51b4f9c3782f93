"""Whether a single feature tells two groups apart: best threshold, leave-one-out accuracy, paired permutation test."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TRIALS = 200


def best_threshold(values: np.ndarray, labels: np.ndarray) -> tuple[float, bool, float]:
    """``(cut, above, balanced accuracy)``: predict True above (or not above) the cut; the least cut wins ties."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    pos, neg = max(y.sum(), 1), max((~y).sum(), 1)
    below_pos, below_neg = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(~y)]
    score = ((pos - below_pos) / pos + below_neg / neg) / 2  # True above
    real = np.r_[True, v[1:] != v[:-1], True]  # cuts between equal values do not exist
    both = np.where(real, np.stack([score, 1 - score]), -1.0)
    best = np.unravel_index(int(both.argmax()), both.shape)
    i = int(best[1])
    cut = -np.inf if i == 0 else float(v[i - 1]) if i == len(v) else float((v[i - 1] + v[i]) / 2)
    return cut, best[0] == 0, float(both[best])


def leave_one_out(values: np.ndarray, labels: np.ndarray) -> float:
    """Share of rows that a threshold fitted on all others labels rightly."""
    hits = 0
    for i in range(len(values)):
        rest = np.arange(len(values)) != i
        cut, above, _ = best_threshold(values[rest], labels[rest])
        hits += ((values[i] > cut) == above) == labels[i]
    return hits / len(values) if len(values) else float("nan")


def permutation_p(values: np.ndarray, labels: np.ndarray, pairs: list[str], trials: int = TRIALS) -> float:
    """Share of label swaps within pairs that separate the groups as well; swaps are the low bits of SHA-256."""
    seen = best_threshold(values, labels)[2]
    hits = 0
    for t in range(trials):
        swap = np.array([hashlib.sha256(f"{t}:{p}".encode()).digest()[-1] & 1 for p in pairs], bool)
        hits += best_threshold(values, labels ^ swap)[2] >= seen - 1e-12
    return (hits + 1) / (trials + 1)


def blind_features(rows: DataFrame, trials: int = TRIALS) -> DataFrame:
    """``(feature, n, accuracy, loo_accuracy, p_value)`` of ``rows(feature, pair, value, label)``.

    A feature's rows are a reviewed set and are handled in one task. Null values and labels are left out; one label
    alone gives accuracy 0.5 or more and a p-value of 1.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pair", "label", "value"])
        v, y = pdf["value"].to_numpy(float), pdf["label"].to_numpy(bool)
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "n": [len(v)], "accuracy": [best_threshold(v, y)[2]], "loo_accuracy": [leave_one_out(v, y)], "p_value": [permutation_p(v, y, list(pdf["pair"].astype(str)), trials)]})

    known = rows.where("feature is not null and value is not null and label is not null").selectExpr("feature", "cast(pair as string) pair", "cast(value as double) value", "cast(label as boolean) label")
    return known.groupBy("feature").applyInPandas(run, "feature string, n long, accuracy double, loo_accuracy double, p_value double")
