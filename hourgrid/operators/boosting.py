"""Boosted trees for 0/1 labels by histograms, with a learned direction for missing values.

Features are cut to bins once. Rows lie in blocks of a byte per feature; for each level of a tree
tasks sum gradients per node, feature and bin over their blocks, sums of tasks are added up, and
the driver looks for the best split of each node. What goes between machines has the size of nodes x bins, whatever the number of rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions import files
from hourgrid.functions.storage import shared_folder
from hourgrid.operators.scoring import one_hot

#: The bin of missing values; other bins are 0 to 254.
MISSING = 255
#: Rows of a block.
BLOCK = 1 << 16
#: Distinct values up to which a feature's cuts are the midpoints between its values.
FEW = 1000
#: Rounds after which the rows' scores are written, so that a job walks no more trees than that.
REFRESH = 20
#: Tasks' sums that one reducer adds up at once, and bytes of sums that may come to the driver for a level.
FAN_IN, DRIVER_BYTES = 64, 32 << 20
#: Gains within this share of the best count as equal; the first feature, then bin, is taken.
EQUAL = 1e-9


@dataclass
class Node:
    """Sums of gradients, hessians and rows, and the split if there is one: (gain, feature, bin, missing goes left)."""

    g: float = 0.0
    h: float = 0.0
    n: float = 0.0
    split: tuple[float, int, int, bool] | None = None
    left: int = 0
    right: int = 0


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    max_leaves: int = 31
    min_rows: int = 20
    min_hessian: float = 1e-3
    min_gain: float = 1e-7
    l2: float = 0.0


@dataclass
class Boosted:
    """A fitted ensemble. ``cuts`` are each feature's thresholds; trees are arrays of (feature, bin, left,
    right, missing goes left, value), feature -1 for a leaf."""

    features: list[str]
    cuts: list[np.ndarray]
    baseline: float
    trees: list[np.ndarray] = field(default_factory=list)

    def bundle(self) -> dict:
        """The same trees over values instead of bins, as :mod:`hourgrid.operators.scoring` reads them. Thresholds
        keep all digits: they are data values or stand between two."""
        def node(f: float, b: float, left: float, right: float, missing: float, value: float) -> list:
            if f < 0:
                return [-1, float(value), 0, 0, 0]
            cut = self.cuts[int(f)]
            return [int(f), float(cut[int(b)]) if b < len(cut) else float("inf"), int(left), int(right), int(missing)]

        return {"features": list(self.features), "baseline": float(self.baseline), "trees": [[node(*row) for row in tree] for tree in self.trees]}


def bin_cuts(df: DataFrame, columns: dict[str, Column], bins: int = 255) -> list[np.ndarray]:
    """Thresholds of each column: between all of its values if these are at most ``bins``, else values at even
    quantiles (a sketch of bounded size). Nulls and NaN are left out. Two passes over the rows."""
    if not 2 <= bins <= MISSING:
        raise ValueError(f"2 to {MISSING} bins fit a byte")
    clean = df.select(*[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"c{i}") for i, c in enumerate(columns.values())])
    names = clean.columns
    count = clean.agg(*[F.approx_count_distinct(n, 0.02).alias(n) for n in names]).first()
    few = [n for n in names if count[n] <= FEW]
    probs = F.lit([i / bins for i in range(1, bins)])
    aggs = [F.collect_set(n).alias(n) if n in few else F.percentile_approx(n, probs, 40 * bins).alias(n) for n in names]
    got = clean.agg(*aggs).first()  # FEW values or ``bins`` quantiles per column
    cuts = []
    for n in names:
        v = np.unique(np.array(got[n] or [], float))
        if n in few and len(v) > bins:
            v = np.unique(np.quantile(v, [i / bins for i in range(1, bins)], method="lower"))
            cuts.append(v)
        else:
            cuts.append((v[:-1] + v[1:]) / 2 if n in few else v)
    return cuts


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Rows x features of bins: the number of cuts below a value; NaN has :data:`MISSING`."""
    out = np.empty(x.shape, np.uint8)
    for i, cut in enumerate(cuts):
        out[:, i] = np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(cut, x[:, i]))
    return out


def walk(bins: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    feature, cut, left, right = (tree[:, i].astype(np.int64) for i in range(4))
    missing, rows, at = tree[:, 4] == 1, np.arange(len(bins)), np.zeros(len(bins), np.int64)
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        v = bins[rows, np.maximum(f, 0)]
        at = np.where(inner, np.where(np.where(v == MISSING, missing[at], v <= cut[at]), left[at], right[at]), at)


def raw_scores(bins: np.ndarray, trees: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for tree in trees:
        out += tree[walk(bins, tree), 5]
    return out


def histograms(bins: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, sizes: list[int]) -> list[np.ndarray]:
    """Per feature an array (3, slots, its bins and one for missing) of summed gradients, hessians and rows. Rows
    whose ``slot`` is negative are left out."""
    own = np.flatnonzero(slot >= 0)
    g, h, slot, out = g[own], h[own], slot[own], []
    for f, size in enumerate(sizes):
        b = bins[own, f].astype(np.int64)
        at = slot * (size + 1) + np.where(b == MISSING, size, b)
        n = slots * (size + 1)
        out.append(np.stack([np.bincount(at, w, n) for w in (g, h, None)]).reshape(3, slots, size + 1).astype(np.float64))
    return out


def _score(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2 + 1e-300)


def best_splits(sums: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each slot of one feature's histogram the best split: gain (-inf if none is allowed), bin, whether missing values go left,
    and the left side's gradients, hessians and rows. Rows up to the bin go left; the last bin stands for
    missing values on the right alone. Where no value is missing, missing ones will go to the larger side."""
    total, gone, slots = sums.sum(axis=2), sums[:, :, -1], np.arange(sums.shape[1])
    left = np.cumsum(sums[:, :, :-1], axis=2)

    def best(part: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest = total[:, :, None] - part
        ok = allowed & (np.minimum(part[2], rest[2]) >= settings.min_rows) & (np.minimum(part[1], rest[1]) >= settings.min_hessian)
        gain = _score(part[0], part[1], settings.l2) + _score(rest[0], rest[1], settings.l2) - _score(total[0], total[1], settings.l2)[:, None]
        gain = np.where(ok, gain, -np.inf)
        top = gain.max(axis=1)
        at = np.argmax(gain >= np.where(np.isfinite(top), top - EQUAL * np.abs(top), top)[:, None], axis=1)
        return gain[slots, at], at, part[:, slots, at]

    some = gone[2] > 0
    inner = np.arange(left.shape[2]) < left.shape[2] - 1
    gain, at, part = best(left, inner | some[:, None])
    gain2, at2, part2 = best(left + gone[:, :, None], inner & some[:, None])
    other = gain2 > gain * (1 + EQUAL)
    part = np.where(other, part2, part)
    to_left = np.where(some, other, part[2] > total[2] - part[2])
    return np.where(other, gain2, gain), np.where(other, at2, at), to_left, part.T


def pruned(nodes: list[Node], settings: Settings) -> np.ndarray:
    """The tree that grows best-first to ``max_leaves``: a node's split doesn't depend on the order of growth, so it is
    chosen from the tree grown to full depth."""
    kept, leaves, heap = set(), 1, []
    push = lambda i: heapq.heappush(heap, (-nodes[i].split[0], i)) if nodes[i].split else None
    push(0)
    while heap and leaves < settings.max_leaves:
        _, i = heapq.heappop(heap)
        kept.add(i)
        leaves += 1
        push(nodes[i].left)
        push(nodes[i].right)
    order, rows = [0], []
    for i in order:  # children are added behind their parents
        node = nodes[i]
        if i in kept:
            _, f, b, missing = node.split
            rows.append((f, b, len(order), len(order) + 1, missing, 0.0))
            order += [node.left, node.right]
        else:
            rows.append((-1, 0, 0, 0, 0, -settings.rate * node.g / (node.h + settings.l2 + 1e-300)))
    return np.array(rows, np.float64)


def _grown(nodes: list[Node]) -> np.ndarray:
    """The tree so far, nodes in their own order; nodes without split are leaves."""
    return np.array([(n.split[1], n.split[2], n.left, n.right, n.split[3], 0.0) if n.split and n.left else (-1, 0, 0, 0, 0, 0.0) for n in nodes], np.float64)


class _Blocks:
    """The binned rows with their scores: written to the shared folder, and cached from there as rows that
    Python tasks take. Growing a tree is per-block arithmetic, a job per level, so jobs are RDD jobs: they
    start several times faster than queries, and do nothing that a query planner could help with."""

    schema = "bins binary, y binary, w binary, raw binary"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.df, self.rdd = spark, None, None, None

    def put(self, df: DataFrame) -> None:
        """Write a new state, then let the old one go."""
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop()
        # As many partitions as tasks can run at once: each adds its blocks up before anything is sent.
        self.path, self.df = path, self.spark.read.schema(self.schema).parquet(path).coalesce(2 * self.spark.sparkContext.defaultParallelism)
        self.rdd = self.df.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def drop(self) -> None:
        if self.path is not None:
            self.rdd.unpersist()
            files.delete(self.spark, self.path)


def _arrays(row: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins (rows x features), labels, weights and scores of a block."""
    return np.frombuffer(row[0], np.uint8).reshape(-1, k), *(np.frombuffer(v, np.float64) for v in row[1:])


def _binned(rows: DataFrame, cuts: list[np.ndarray], baseline: float, block: int) -> DataFrame:
    k = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            x = np.concatenate(held)
            made = [to_bins(x[:, :k], cuts).tobytes(), x[:, k].tobytes(), x[:, k + 1].tobytes(), np.full(len(x), baseline).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([m], pa.binary()) for m in made], ["bins", "y", "w", "raw"])

        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]))
            n += batch.num_rows
            if n >= block:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    return rows.mapInArrow(run, _Blocks.schema)


def _rescored(blocks: DataFrame, trees: list[np.ndarray], k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (_arrays(row, k) for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
            raw = [raw_scores(bins, trees, start).tobytes() for bins, _, _, start in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], ["bins", "y", "w", "raw"])

    return blocks.mapInArrow(run, _Blocks.schema)


@dataclass(frozen=True)
class Found:
    """The best split of a node, ``feature`` -1 if there is none; sums of its left side and of the whole node."""

    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: list[float]
    whole: list[float]


def _summed(parts: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sums of tasks, added in the order of their blocks, so that the same blocks give the same tree."""
    return sum(data for _, data in sorted(parts, key=lambda p: p[0]))


def _level(blocks: RDD, recent: list[np.ndarray], tree: np.ndarray, open_: list[int], sizes: list[int], settings: Settings, groups: int) -> list[Found]:
    """The best split of each open node.

    What tasks have summed is added by groups of features, :data:`FAN_IN` tasks at a time, until what is left is at
    most :data:`DRIVER_BYTES`; that comes to the driver, is added up there and searched."""
    k, slots = len(sizes), len(open_)
    slot_of = np.full(len(tree), -1)
    slot_of[open_] = np.arange(slots)
    own = [list(range(k))[i::groups] for i in range(groups)]

    def sums(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        total = None
        for row in rows:
            bins, y, w, start = _arrays(row, k)
            p = 1 / (1 + np.exp(-raw_scores(bins, recent, start)))
            made = histograms(bins, slot_of[walk(bins, tree)], w * (p - y), w * p * (1 - p), slots, sizes)
            total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
        for i, fs in enumerate(own if total is not None else []):
            yield i, (part, np.concatenate([total[f].ravel() for f in fs]))

    pairs, parts = blocks.mapPartitionsWithIndex(sums), blocks.getNumPartitions()
    while parts > 1 and parts * 24 * slots * (sum(sizes) + k) > DRIVER_BYTES:
        pairs = pairs.map(lambda p: ((p[0], p[1][0] // FAN_IN), p[1])).groupByKey().map(lambda p: (p[0][0], (p[0][1], _summed(p[1]))))
        parts = -(-parts // FAN_IN)
    by_group: dict[int, list] = {}
    for i, part in pairs.collect():
        by_group.setdefault(i, []).append(part)
    hist: dict[int, np.ndarray] = {}
    for i, fs in enumerate(own):
        ends = np.cumsum([3 * slots * (sizes[f] + 1) for f in fs])
        hist |= {f: h.reshape(3, slots, -1) for f, h in zip(fs, np.split(_summed(by_group[i]), ends[:-1]), strict=True)}
    gain, feature, at, missing, left = np.full(slots, -np.inf), np.full(slots, -1), np.zeros(slots, int), np.zeros(slots, bool), np.zeros((slots, 3))
    for f in range(k):
        gain2, at2, missing2, left2 = best_splits(hist[f], settings)
        better = (gain2 > settings.min_gain) & ((feature < 0) | (gain2 > gain * (1 + EQUAL)))
        gain, feature, at, missing = (np.where(better, new, old) for new, old in ((gain2, gain), (f, feature), (at2, at), (missing2, missing)))
        left = np.where(better[:, None], left2, left)
    whole = hist[0].sum(axis=2).T
    return [Found(*v) for v in zip(gain.tolist(), feature.tolist(), at.tolist(), missing.tolist(), left.tolist(), whole.tolist(), strict=True)]


def fit_histogram(train: DataFrame, features: list[str], label: str = "label", weight: str | None = "weight", entity_col: str = "entity", settings: Settings = Settings(), bins: int = 255, block: int = BLOCK, groups: int = 8) -> Boosted:
    """Boosted trees on columns ``features`` (``entity_X`` is 1 for entity X, see :func:`one_hot`).

    Each of ``rounds`` trees is grown to ``depth`` by levels and cut back to what best-first growth
    to ``max_leaves`` keeps. Null and NaN values are missing. A job per level reads the cached blocks; scores are written
    every :data:`REFRESH` rounds. Lost executors read their blocks again from the shared folder.

    Defined cases: rows without label or weight are left out; without rows the model is the score 1/2, with one
    label only a constant; repeated rows count each; growth ends early when no split gains anything.
    """
    columns = {n: one_hot(n, entity_col) for n in features}
    rows = train.select(*[c.alias(f"f{i}") for i, c in enumerate(columns.values())], F.col(label).cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")).dropna(subset=["y", "w"])
    cuts = bin_cuts(rows, {f"f{i}": F.col(f"f{i}") for i in range(len(features))}, bins)
    totals = rows.agg(F.sum(F.col("w") * F.col("y")), F.sum("w")).first()
    pos, all_ = (float(v or 0.0) for v in totals)
    rate = min(max(pos / all_, 1e-9), 1 - 1e-9) if all_ > 0 else 0.5
    model = Boosted(list(features), cuts, float(np.log(rate / (1 - rate))))
    if not 0 < pos < all_:
        return model
    sizes, groups = [len(c) + 1 for c in cuts], min(groups, len(features))
    blocks = _Blocks(train.sparkSession)
    blocks.put(_binned(rows, cuts, model.baseline, block))
    recent: list[np.ndarray] = []
    try:
        for _ in range(settings.rounds):
            nodes, open_ = [Node()], [0]
            for _ in range(settings.depth):
                after = []
                for i, r in zip(open_, _level(blocks.rdd, recent, _grown(nodes), open_, sizes, settings, groups), strict=True):
                    node = nodes[i]
                    node.g, node.h, node.n = r.whole
                    if r.feature >= 0:
                        node.split, node.left, node.right = (r.gain, r.feature, r.bin, r.missing_left), len(nodes), len(nodes) + 1
                        nodes += [Node(*r.left), Node(*(a - b for a, b in zip(r.whole, r.left, strict=True)))]
                        after += [node.left, node.right]
                # A node with too few rows for two sides can't split.
                open_ = [i for i in after if nodes[i].n >= 2 * settings.min_rows]
                if not open_:
                    break
            if nodes[0].split is None:
                break
            model.trees.append(pruned(nodes, settings))
            recent.append(model.trees[-1])
            if len(recent) == REFRESH:
                blocks.put(_rescored(blocks.df, recent, len(features)))
                recent = []
    finally:
        blocks.drop()
    return model


def score_boosted(df: DataFrame, model: Boosted, entity_col: str = "entity") -> DataFrame:
    """Adds ``score`` from the fitted model itself: values are binned, and bins go down the trees."""
    trees, cuts, baseline, k = model.trees, model.cuts, model.baseline, len(model.features)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            x = np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in cols[:k]])
            yield pd.Series(1 / (1 + np.exp(-raw_scores(to_bins(x, cuts), trees, np.full(len(x), baseline)))))

    return df.withColumn("score", score(*[one_hot(n, entity_col) for n in model.features]))
