"""Random forests of regression trees by histograms: all trees grow together, a job per level.

Categories and cut numbers are codes of a byte or two; rows lie in blocks. For each tree, tasks draw the weights of
its bootstrap again from the block's number, follow its splits, and sum weights and targets per node and code. Of two
siblings only the lighter one is summed; the other is what its parent has more. What goes between
machines has the size of trees x nodes x codes, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.operators.boosting import BLOCK, MISSING, _Blocks, _summed, bin_cuts, to_bins

#: Blocks whose rows are summed before their table is reduced to sums per column.
BLOCKS = 8
#: Cells up to which columns are counted together; a task's table has so many for each node.
CELLS = 4096
#: Gains up to this share of the target's sum of squares are rounding.
LEAST = 1e-12
#: Depths up to which a position in a tree fits a byte.
MAX_DEPTH = 8
#: The largest weight of a row in a bootstrap; a larger one is rarer than 1e-14.
MOST = 15
NONE = 255


def _poisson() -> tuple[list[int], np.ndarray]:
    """The bytes from which on a random byte stands for one more, as far as probabilities have whole 256ths; the last is where
    bytes begin that stand for the rest. And the cumulated probabilities of that rest."""
    p = np.array([math.exp(-1) / math.factorial(k) for k in range(MOST + 1)])
    whole = np.floor(p * 256).astype(int)
    rest = p * 256 - whole
    return np.cumsum(whole[whole > 0]).tolist(), np.cumsum(rest) / rest.sum()


STEPS, REST = _poisson()


def bag(seed: int, block: int, tree: int, n: int) -> np.ndarray:
    """How often each row of a block is in a tree's bootstrap: independent Poisson counts of mean 1, the same at each call."""
    rng = np.random.Generator(np.random.SFC64([seed, block, tree]))
    drawn = rng.bit_generator.random_raw(-(-n // 8)).view(np.uint8)[:n]
    w = (drawn >= STEPS[0]).view(np.uint8)
    for step in STEPS[1:-1]:
        w += (drawn >= step).view(np.uint8)
    rest = np.flatnonzero(drawn >= STEPS[-1])
    w[rest] = np.searchsorted(REST, rng.random(len(rest)), side="right").clip(max=MOST)
    return w


@dataclass(frozen=True)
class Forest:
    """A fitted forest. Arrays are trees x places, a node's children at 2i and 2i + 1, the root at 1. ``column`` is -1 where a node isn't split;
    codes above ``cut`` go right, in categories the code ``cut`` alone. ``value`` is a node's mean target, ``gain`` what its split takes off
    the summed squares."""

    levels: dict[str, list[str]]
    numbers: list[str]
    cuts: list[np.ndarray]
    depth: int
    column: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, the mean of the trees. A level that training lacked is none of the known ones; a missing number
        counts as larger than all."""
        cuts, categories, depth, column, cut, ends = self.cuts, len(self.levels), self.depth, self.column.tolist(), self.cut.tolist(), self.value[:, 1 << self.depth :]

        @F.pandas_udf("double")
        def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                cols = cols if isinstance(cols, tuple) else (cols,)  # a single column comes bare
                codes = coded([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in cols], categories, cuts)
                total = np.zeros(codes.shape[1])
                for t in range(len(column)):
                    total += ends[t].take(place(sides(codes, column[t], cut[t], categories, depth), len(total)))
                yield pd.Series(total / max(1, len(column)))

        return df.withColumn("prediction", predict(*inputs(self.levels, self.numbers)))

    def importances(self) -> dict[str, float]:
        """Each feature's share of what splits gain, a tree's gains summing to 1."""
        at = [(c, v) for c, vs in enumerate(self.levels.values()) for v in range(len(vs))] + [(c, -1) for c in range(len(self.levels), len(self.levels) + len(self.numbers))]
        names = [f"{c}={v}" for c, vs in self.levels.items() for v in vs] + self.numbers
        inner = self.column >= 0
        gain = np.where(inner, self.gain, 0.0)
        gain = gain / np.maximum(gain.sum(axis=1, keepdims=True), 1e-300)
        own = [gain[inner & (self.column == c) & ((self.cut == v) | (v < 0))].sum() for c, v in at]
        return dict(zip(names, (np.array(own) / max(sum(own), 1e-300)).tolist(), strict=True))


def inputs(levels: dict[str, list[str]], numbers: list[str]) -> list[Column]:
    """The place of each category's value among ``levels``, their number for any other, and the numbers."""
    place = [F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(vs) for x in (v, float(i))]), F.col(c).cast("string")), F.lit(float(len(vs)))) if vs else F.lit(0.0) for c, vs in levels.items()]
    return [*place, *[F.col(n).cast("double") for n in numbers]]


def coded(columns: list[np.ndarray], categories: int, cuts: list[np.ndarray]) -> np.ndarray:
    """Columns x rows of codes; a missing number has the last one of its column."""
    n = len(columns[0])
    bins = to_bins(np.column_stack(columns[categories:]), cuts) if cuts else np.empty((n, 0), np.uint8)
    wide = max([MISSING, *[c.max(initial=0) for c in columns[:categories]]]) > 255
    out = np.empty((len(columns), n), np.uint16 if wide else np.uint8)
    for i, c in enumerate(columns[:categories]):
        out[i] = c
    for i, cut in enumerate(cuts):
        out[categories + i] = np.minimum(bins[:, i], len(cut))
    return out


def sides(codes: np.ndarray, column: list[int], cut: list[int], categories: int, depth: int, wanted: list[int] | None = None) -> list[np.ndarray]:
    """The side (0 or 1) that each row takes at each level; where a node isn't split, left. With ``wanted``, a side for each node of the last
    level (-1: neither), the last bytes say instead whether a row takes it.

    A level's side is chosen from those of all its nodes by the sides taken before: bytes of whole columns, no gathering."""
    taken: list[np.ndarray] = []
    none = np.zeros(codes.shape[1], np.uint8)
    for level in range(depth):
        side, first = [], 1 << level
        for i in range(first, 2 * first):
            c, v, want = column[i], cut[i], 1 if wanted is None or level < depth - 1 else wanted[i - first]
            if c < 0 or want < 0:
                side.append(none)
            elif c < categories:
                side.append((codes[c] == v if want else codes[c] != v).view(np.uint8))
            else:
                side.append((codes[c] > v if want else codes[c] <= v).view(np.uint8))
        for before in reversed(taken):
            side = [a if a is b else a ^ ((a ^ b) & before) for a, b in zip(side[::2], side[1::2], strict=True)]
        taken.append(side[0])
    return taken


def place(taken: list[np.ndarray], n: int) -> np.ndarray:
    """The place of each row among the nodes of the level that these sides lead to."""
    at = np.zeros(n, np.uint8)
    for side in taken:
        at = at << 1 | side
    return at


def together(sizes: list[int], most: int = CELLS) -> list[list[int]]:
    """Columns in few groups whose numbers of codes multiply to at most ``most``; a larger column is alone."""
    groups: list[list[int]] = []
    for c in sorted(range(len(sizes)), key=lambda c: (-sizes[c], c)):
        home = next((g for g in groups if math.prod(sizes[i] for i in g) * sizes[c] <= most), None)
        home.append(c) if home is not None else groups.append([c])
    return groups


def _blocks(rows: DataFrame, categories: int, cuts: list[np.ndarray], mean: float, block: int) -> DataFrame:
    """Rows of input columns and the target as blocks, numbered, the target less ``mean``."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made, part = [], 0, 0, TaskContext.get().partitionId()

        def packed() -> pa.RecordBatch:
            cols = [np.concatenate(v) for v in zip(*held, strict=True)]
            codes = coded(cols[:-1], categories, cuts)
            wide = codes.dtype.itemsize
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), pa.array([wide], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([(cols[-1] - mean).tobytes()], pa.binary())], ["id", "wide", "codes", "y"])

        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
            n += b.num_rows
            if n >= block:
                yield packed()
                held, n, made = [], 0, made + 1
        if n:
            yield packed()

    return rows.mapInArrow(run, _Rows.schema)


class _Rows(_Blocks):
    schema = "id long, wide int, codes binary, y binary"


def _level(blocks: RDD, level: int, column: np.ndarray, cut: np.ndarray, wanted: np.ndarray, sizes: list[int], categories: int, seed: int, shares: int) -> np.ndarray:
    """Trees x nodes x codes of all columns x (weight, weighted target): of the root, or of one child of each node of the level above, whose
    side ``wanted`` has (trees x nodes; -1: neither)."""
    trees, slots, ends, groups = len(column), 1 << max(level - 1, 0), np.cumsum([0, *sizes]), together(sizes)
    column, cut, wanted = column.tolist(), cut.tolist(), wanted.tolist()
    cells = [math.prod(sizes[c] for c in g) for g in groups]
    own = [range(trees)[i::shares] for i in range(shares)]

    def joint(codes: np.ndarray, group: list[int]) -> np.ndarray:
        out = np.zeros(codes.shape[1], np.int64)
        for c in group:
            out = out * sizes[c] + codes[c]
        return out.astype(np.uint16)

    def summed(chunk: list[tuple], t: int) -> np.ndarray:
        table = [np.zeros((2, slots * k)) for k in cells]
        for id_, codes, y, at in chunk:
            w = bag(seed, id_, t, len(y))
            inside = w != 0
            if level:
                taken = sides(codes, column[t], cut[t], categories, level, wanted[t])
                inside &= taken.pop().view(bool)
            rows = np.flatnonzero(inside)
            w, y = w.take(rows).astype(np.float64), y.take(rows)
            at = [a.take(rows) for a in at]
            if level > 1:
                slot = place(taken, len(codes[0])).take(rows).astype(np.int64)
                at = [slot * k + a for k, a in zip(cells, at, strict=True)]
            wy = w * y
            for into, k, a in zip(table, cells, at, strict=True):
                into[0] += np.bincount(a, w, slots * k)
                into[1] += np.bincount(a, wy, slots * k)
        out = np.empty((slots, ends[-1], 2))
        for into, g in zip(table, groups, strict=True):
            cube = into.reshape(2, slots, *[sizes[c] for c in g])
            for i, c in enumerate(g):
                out[:, ends[c] : ends[c + 1]] = np.moveaxis(cube.sum(axis=tuple(2 + j for j in range(len(g)) if j != i)), 0, -1)
        return out

    def task(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros((trees, slots, ends[-1], 2))
        chunk: list[tuple] = []

        def add() -> None:
            for t in range(trees):
                total[t] += summed(chunk, t)
            chunk.clear()

        for id_, wide, codes, y in rows:
            codes = np.frombuffer(codes, np.uint8 if wide == 1 else np.uint16).reshape(len(sizes), -1)
            chunk.append((id_, codes, np.frombuffer(y, np.float64), [joint(codes, g) for g in groups]))
            if len(chunk) == BLOCKS:
                add()
        if chunk:
            add()
        for i, ts in enumerate(own):
            yield i, (part, total[ts])

    out = np.zeros((trees, slots, ends[-1], 2))
    for i, data in blocks.mapPartitionsWithIndex(task).groupByKey().mapValues(_summed).collect():  # trees x nodes x codes
        out[own[i]] = data
    return out


def best_splits(sums: np.ndarray, sizes: list[int], levels: list[int], allowed: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node of ``sums`` (nodes x codes x 2) the gain, column (-1: none), cut and the right side's weight of its best split.
    Features are each level of the categories (of ``levels`` many), then each number; ``allowed`` is nodes x features."""
    ends, total = np.cumsum([0, *sizes]), sums[:, : sizes[0]].sum(axis=1)
    right, at, feature = [], [], []
    for c, size in enumerate(sizes):
        own = sums[:, ends[c] : ends[c + 1]]
        if c < len(levels):
            right.append(own[:, : levels[c]])
            at += [(c, v) for v in range(levels[c])]
            feature += range(len(feature) and feature[-1] + 1, (len(feature) and feature[-1] + 1) + levels[c])
        else:
            right.append(total[:, None] - np.cumsum(own, axis=1)[:, :-1])
            at += [(c, v) for v in range(size - 1)]
            feature += [sum(levels) + c - len(levels)] * (size - 1)
    if not at:
        none = np.full(len(sums), -1)
        return np.zeros(len(sums)), none, none, np.zeros(len(sums))
    r = np.concatenate(right, axis=1)
    left = total[:, None] - r
    ok = allowed[:, feature] & (r[..., 0] > 0.5) & (left[..., 0] > 0.5)  # weights are whole
    square = lambda x: x[..., 1] ** 2 / np.maximum(x[..., 0], 1e-300)
    gain = np.where(ok, square(np.where(ok[..., None], r, 0)) + square(np.where(ok[..., None], left, 0)) - square(total)[:, None], -np.inf)
    top, nodes, pairs = gain.argmax(axis=1), np.arange(len(sums)), np.array(at)
    found = gain[nodes, top] > least
    return np.where(found, gain[nodes, top], 0.0), np.where(found, pairs[top, 0], -1), np.where(found, pairs[top, 1], -1), r[nodes, top, 0]


def fit_forest(train: DataFrame, levels: dict[str, list[str]], numbers: list[str], target: str, trees: int = 300, depth: int = 5, bins: int = 32, seed: int = 42, block: int = BLOCK) -> Forest:
    """A forest on 0/1 columns for ``levels`` of categories and on ``numbers`` cut to ``bins``.

    Each tree has a bootstrap of all rows (Poisson weights of mean 1) and at each node a third of the features, rounded up; splits are those of
    the least squared error. Trees depend on the seed and on how rows lie in blocks.

    Defined cases: rows without target are left out; without rows the prediction is null; repeated rows are drawn each; a node
    that no split improves is a leaf.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"a depth of 1 to {MAX_DEPTH}")
    rows = train.select(*[c.alias(f"x{i}") for i, c in enumerate(inputs(levels, numbers))], F.col(target).cast("double").alias("y")).dropna(subset=["y"])
    k = len(levels)
    cuts = bin_cuts(rows, {n: F.col(f"x{k + i}") for i, n in enumerate(numbers)}, bins) if numbers else []
    n, mean, spread = rows.agg(F.count("y"), F.avg("y"), F.var_pop("y")).first()
    sizes, counts = [*[len(v) + 1 for v in levels.values()], *[len(c) + 1 for c in cuts]], [len(v) for v in levels.values()]
    column, cut = (np.full((trees, 2 << depth), -1) for _ in range(2))
    gain, value = np.zeros((trees, 2 << depth)), np.full((trees, 2 << depth), np.nan)
    forest = Forest(levels, list(numbers), cuts, depth, column, cut, gain, value)
    if not n:
        return forest
    features = sum(counts) + len(numbers)
    rng, some = np.random.default_rng(seed), -(-features // 3)
    blocks = _Rows(train.sparkSession)
    blocks.put(_blocks(rows, k, cuts, mean, block))
    value[:, 1] = mean
    try:
        wanted, lighter, parents = np.ones((trees, 1), int), None, None
        for level in range(depth + 1):
            first, width = 1 << level, 1 << level
            here = slice(first, first + width)
            if level == depth or level and not (column[:, first // 2 : first] >= 0).any():
                break
            sums = _level(blocks.rdd, level, column, cut, wanted, sizes, k, seed, min(trees, 16))
            if level:
                # The heavier sibling has what the parent has more.
                both = np.stack([sums, parents - sums], axis=2)
                sums = np.where((lighter == 0)[..., None, None, None], both, both[:, :, ::-1]).reshape(trees, width, *sums.shape[2:])
            flat = sums.reshape(trees * width, *sums.shape[2:])
            open_ = column[:, first // 2 : first].repeat(2, axis=1) >= 0 if level else np.ones((trees, 1), bool)
            drawn = rng.random((trees * width, features)).argsort(axis=1) < some
            g, c, v, right = (x.reshape(trees, width) for x in best_splits(flat, sizes, counts, drawn & open_.reshape(-1, 1), LEAST * n * spread))
            gain[:, here], column[:, here], cut[:, here] = g, c, v
            # Means of the children; a leaf's value goes down to the last level.
            total = flat[:, : sizes[0]].sum(axis=1).reshape(trees, width, 2)
            _values(value, sums, total, c, v, mean, first, sizes, k)
            lighter = (2 * right <= total[..., 0]).astype(int)
            wanted = np.where(c >= 0, lighter, -1)
            parents = sums
        for i in range(first, 1 << depth):  # levels that no tree reached
            value[:, 2 * i] = value[:, 2 * i + 1] = value[:, i]
    finally:
        blocks.drop()
    return forest


def _values(value: np.ndarray, sums: np.ndarray, total: np.ndarray, column: np.ndarray, cut: np.ndarray, mean: float, first: int, sizes: list[int], categories: int) -> None:
    """Sets the values of a level's nodes from their sums, and those of their children; where a node has none, its parent's stays."""
    ends, width = np.cumsum([0, *sizes]), column.shape[1]
    at = np.arange(ends[-1])
    start, c = ends[np.maximum(column, 0)], np.maximum(column, 0)
    inside = (at >= start[..., None]) & (at < ends[c + 1][..., None])
    goes = inside & np.where((c < categories)[..., None], at == (start + cut)[..., None], at > (start + cut)[..., None])
    right = (sums * goes[..., None]).sum(axis=2)
    own = value[:, first : first + width]
    own[...] = np.where(total[..., 0] > 0.5, mean + total[..., 1] / np.maximum(total[..., 0], 0.5), own)
    for side, part in ((0, total - right), (1, right)):
        made = mean + part[..., 1] / np.maximum(part[..., 0], 0.5)
        value[:, 2 * first + side : 2 * (first + width) : 2] = np.where((column >= 0) & (part[..., 0] > 0.5), made, own)
