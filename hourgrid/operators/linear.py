"""Least squares from sums of squares and products, per fold: one scan fits and judges every fold.

A fold's sums are a matrix of the width of the design. Those of training rows are the total less the fold's; coefficients,
R2 and RMSE of every fold follow from such matrices without the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a category at most: each is a column of the design.
MAX_LEVELS = 500


@dataclass(frozen=True)
class Line:
    """``intercept`` and a coefficient for each design column (``names``), on unscaled inputs; ``scale`` is the standard
    deviation of numbers in training, 1 for levels."""

    names: list[str]
    intercept: float
    slopes: np.ndarray
    scale: np.ndarray


@dataclass(frozen=True)
class Sums:
    """Per fold the matrix of sums of products of (1, design columns, target)."""

    numbers: list[str]
    levels: dict[str, list[str]]
    by_fold: dict[int, np.ndarray]

    def names(self) -> list[str]:
        return [f"{c}={v}" for c, vs in self.levels.items() for v in vs] + self.numbers

    def of(self, folds: list[int]) -> np.ndarray:
        k = len(self.names()) + 2
        return sum((self.by_fold[f] for f in folds if f in self.by_fold), np.zeros((k, k)))


def category_levels(train: DataFrame, categories: list[str]) -> dict[str, list[str]]:
    """The values of each category in training, in order; ValueError beyond :data:`MAX_LEVELS`."""
    if not categories:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(categories)]))
    pairs = train.select(cells.alias("x")).select("x.*").filter("v is not null").distinct().limit(MAX_LEVELS * len(categories) + 1).collect()
    found: dict[str, list[str]] = {c: sorted(r["v"] for r in pairs if r["i"] == i) for i, c in enumerate(categories)}
    if len(pairs) > MAX_LEVELS * len(categories) or max(map(len, found.values())) > MAX_LEVELS:
        raise ValueError(f"a category has more than {MAX_LEVELS} levels")
    return found


def fold_sums(rows: DataFrame, levels: dict[str, list[str]], numbers: list[str], target: str, fold: Column) -> Sums:
    """Sums of products per ``fold`` (an int). A level that ``levels`` lacks is all zero; rows with a null number or target, or
    without fold, are left out. Each task multiplies its batches and sends one matrix a fold; those are added by Spark."""
    design = [(F.col(c).cast("string") == v).cast("double") for c, vs in levels.items() for v in vs] + [F.col(n).cast("double") for n in numbers]
    flat = rows.select(fold.cast("int").alias("fold"), *[F.coalesce(d, F.lit(0.0)).alias(f"x{i}") if i < len(design) - len(numbers) else d.alias(f"x{i}") for i, d in enumerate(design)], F.col(target).cast("double").alias("y")).dropna()
    k = len(design) + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            of = b.column(0).to_numpy()
            z = np.column_stack([np.ones(b.num_rows), *[c.to_numpy() for c in b.columns[1:]]])
            for f in np.unique(of):
                own = z[of == f]
                total[int(f)] = total.get(int(f), 0) + own.T @ own
        i, j = (v.ravel() for v in np.indices((k, k)))
        for f, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * k, f), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m.ravel(), pa.float64())], ["fold", "i", "j", "v"])

    out: dict[int, np.ndarray] = {}
    for r in flat.mapInArrow(products, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect():  # k x k a fold
        out.setdefault(r["fold"], np.zeros((k, k)))[r["i"], r["j"]] = r["v"]
    return Sums(numbers, levels, out)


def solve(sums: Sums, folds: list[int]) -> Line:
    """Least squares over the rows of ``folds``: numbers standardised, all centred; of equally good solutions the one of
    least norm, as levels of a category sum to one. Without rows, all zero."""
    m, names = sums.of(folds), sums.names()
    n, k = m[0, 0], len(names)
    if n == 0:
        return Line(names, 0.0, np.zeros(k), np.ones(k))
    mean = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    scale = np.ones(k)
    at = slice(k - len(sums.numbers), k)
    scale[at] = np.sqrt(np.maximum(np.diag(centred)[:-1][at] / n, 0))
    scale[scale < 1e-12 * np.maximum(np.abs(mean[:-1]), 1e-300)] = 1.0
    x = centred[:-1, :-1] / np.outer(scale, scale)
    beta = np.linalg.pinv(x, rcond=1e-10, hermitian=True) @ (centred[:-1, -1] / scale)
    return Line(names, float(mean[-1] - mean[:-1] @ (beta / scale)), beta / scale, scale)


def judged(sums: Sums, folds: list[int], line: Line) -> tuple[int, float, float]:
    """(rows, R2, RMSE) of a line on the rows of ``folds``, from their sums alone."""
    m = sums.of(folds)
    n = m[0, 0]
    if n == 0:
        return 0, float("nan"), float("nan")
    v = np.r_[-line.intercept, -line.slopes, 1.0]
    wrong, spread = max(float(v @ m @ v), 0.0), float(m[-1, -1] - m[0, -1] ** 2 / n)
    return int(n), (1 - wrong / spread if spread > 0 else float("nan")), float(np.sqrt(wrong / n))


def predicted(df: DataFrame, line: Line, levels: dict[str, list[str]], numbers: list[str]) -> DataFrame:
    """Adds ``prediction``; null where a number is."""
    total, at = F.lit(float(line.intercept)), 0
    for c, values in levels.items():
        if values:
            table = F.create_map(*[F.lit(x) for v, b in zip(values, line.slopes[at:], strict=False) for x in (v, float(b))])
            total = total + F.coalesce(F.try_element_at(table, F.col(c).cast("string")), F.lit(0.0))
        at += len(values)
    for n, b in zip(numbers, line.slopes[at:], strict=True):
        total = total + F.col(n).cast("double") * F.lit(float(b))
    return df.withColumn("prediction", total)


#: The fold of test rows.
TEST = -1


def split_sums(rows: DataFrame, categories: list[str], numbers: list[str], target: str, keys: list[str], folds: int = 5) -> Sums:
    """Sums of ``rows`` with a ``split``: training rows in ``folds`` by a hash of their keys, test rows as :data:`TEST`. Levels are
    those of training rows."""
    fold = F.when(F.col("split") == "train", F.pmod(F.xxhash64(*keys), F.lit(folds))).when(F.col("split") == "test", TEST)
    return fold_sums(rows, category_levels(rows.filter("split = 'train'"), categories), numbers, target, fold)


def cross_validated(sums: Sums, folds: int = 5) -> list[tuple[int, float]]:
    """(fold, R2) of a line fitted on all other training folds; nothing is read again."""
    every = list(range(folds))
    return [(f, judged(sums, [f], solve(sums, [g for g in every if g != f]))[1]) for f in every]
