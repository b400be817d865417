"""Bounded, reproducible samples of labelled rows, and small linear fits on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.sampling import hash_sample
from hourgrid.llm.common import crc_fold

#: Labelled rows that a model is fitted on at most. They are chosen by a hash of the id,
#: so the choice is the same in every run and for any order of rows.
MAX_LABELLED = 50_000


def labelled_sample(labels: DataFrame, label_col: str, id_col: str = "doc_id", max_rows: int = MAX_LABELLED) -> DataFrame:
    """(``__id``, ``__y``, ``__fold``) of at most ``max_rows`` labelled ids that are not held out
    (crc32 of the id modulo 5 is not 0), in hash order. Nulls are no labels; an id with
    several labels has the largest."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_fold(F.col(id_col)) != 0))
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    return hash_sample(rows.withColumn("__fold", crc_fold(F.col("__id"))), max_rows, ["__id"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression by Newton steps on
    standardised columns. Without both classes: no slope, the smoothed rate as intercept."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return np.r_[np.zeros(x.shape[1]), np.log(rate / (1 - rate))]
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.r_[np.zeros(x.shape[1]), np.log(rate / (1 - rate))]
    penalty = np.r_[np.full(x.shape[1], ridge * len(y)), 0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return np.r_[w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum()]
