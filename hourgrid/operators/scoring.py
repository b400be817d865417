"""Scoring tables with exported regression trees.

A bundle is a dict: ``features`` (names), ``baseline`` (float), ``trees`` (lists of nodes
[feature, threshold, left, right, missing goes left]; a leaf is [-1, value, 0, 0, 0]),
``reference`` (feature -> value), ``profiles`` (entity -> feature -> value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def walk_trees(x: np.ndarray, trees: list[list[list[float]]], baseline: float) -> np.ndarray:
    """Sigmoid of the summed leaves. All rows go down a tree together, a level at a time:
    left if the value is at most the threshold, NaN by the node's flag."""
    total = np.full(len(x), baseline)
    rows = np.arange(len(x))
    for tree in trees:
        table = np.array(tree, dtype=np.float64)
        feature, left, right, missing = (table[:, i].astype(np.int64) for i in (0, 2, 3, 4))
        at = np.zeros(len(x), np.int64)
        while True:
            open_ = rows[feature[at] >= 0]
            if not len(open_):
                break
            node = at[open_]
            value = x[open_, feature[node]]
            go = np.where(np.isnan(value), missing[node] == 1, value <= table[node, 1])
            at[open_] = np.where(go, left[node], right[node])
        total += table[at, 1]
    return 1 / (1 + np.exp(-total))


def one_hot(name: str, entity_col: str = "entity") -> Column:
    """A feature as a double; ``entity_X`` is 1 for entity X."""
    if name.startswith("entity_"):
        return (F.col(entity_col) == name.removeprefix("entity_")).cast("double")
    return F.col(name).cast("double")


def score_trees(df: DataFrame, bundle: dict, entity_col: str = "entity") -> DataFrame:
    """Adds ``score``. The bundle, of fixed size, goes with the tasks; rows go in Arrow batches."""
    trees, baseline = bundle["trees"], float(bundle["baseline"])

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(walk_trees(np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in cols]), trees, baseline))

    return df.withColumn("score", score(*[one_hot(n, entity_col) for n in bundle["features"]]))


def tree_expression(bundle: dict, entity_col: str = "entity") -> Column:
    """The same score as a Spark expression, for small bundles: nested conditions per tree."""
    inputs = [one_hot(n, entity_col) for n in bundle["features"]]

    def node(tree: list, i: int) -> Column:
        feature, value, left, right, missing = tree[i]
        if feature < 0:
            return F.lit(float(value))
        x = inputs[int(feature)]
        low, high = node(tree, int(left)), node(tree, int(right))
        return F.when(x.isNull() | F.isnan(x), low if missing else high).when(x <= float(value), low).otherwise(high)

    total = F.lit(float(bundle["baseline"]))
    for tree in bundle["trees"]:
        total = total + node(tree, 0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_parity(a: DataFrame, b: DataFrame, keys: list[str], limit: float = 1e-5) -> DataFrame:
    """One row: rows compared, largest difference of ``score``, whether it is under ``limit``."""
    both = a.select(*keys, F.col("score").alias("__a")).join(b.select(*keys, F.col("score").alias("__b")), keys)
    worst = F.max(F.abs(F.col("__a") - F.col("__b")))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), worst.alias("max_difference"), (worst < limit).alias("passed"))


def scenarios(spark: SparkSession, bundle: dict, entities: list[str]) -> DataFrame:
    """One row per entity and ``with_profile`` (0, 1): the reference values, the entity's own
    profile over them, and the windows that follow from others kept coherent."""
    numeric = [n for n in bundle["features"] if not n.startswith("entity_")]
    rows = []
    for e in entities:  # a constant of the policy
        for own in (0, 1):
            v = {n: bundle["reference"].get(n) for n in numeric} | (bundle["profiles"].get(e, {}) if own else {})
            rows.append((e, own, *[None if v[n] is None else float(v[n]) for n in numeric]))
    df = spark.createDataFrame(rows, "entity string, with_profile int, " + ", ".join(f"{n} double" for n in numeric))
    derived = {
        "rate_prior_7d": F.col("rate_prior_30d"), "starts_prior_1h": F.least("starts_prior_3h", F.lit(2.0)), "starts_prior_6h": F.col("starts_prior_3h") * 1.6,
        "system_starts_prior_1h": F.col("system_starts_prior_3h") / 3, "system_starts_prior_6h": F.col("system_starts_prior_3h") * 1.7,
    }
    return df.withColumns({n: c for n, c in derived.items() if n in numeric})


def scenario_scores(spark: SparkSession, bundle: dict, entities: list[str]) -> DataFrame:
    return score_trees(scenarios(spark, bundle, entities), bundle).select("entity", "with_profile", "score")
