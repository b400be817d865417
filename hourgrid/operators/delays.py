"""Monthly running times: delays, their distribution, and medians for profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.quantiles import exact_quantiles, grouped_medians


def delay_rows(running: DataFrame) -> DataFrame:
    """Adds ``delay_min`` (actual less scheduled), month and year; rows without positive
    distance, stops and trains are left out."""
    df = running.filter("distance > 0 and number_of_stops > 0 and scheduled_trains > 0")
    return df.withColumns({"delay_min": F.col("avg_actual_runtime") - F.col("avg_scheduled_runtime"), "month": F.month("month_date"), "year": F.year("month_date")})


def clip_quantile(df: DataFrame, col: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows within two quantiles (linear, inclusive) of ``col``."""
    cuts = exact_quantiles(df, F.col(col), [low, high])
    return df.filter(F.col(col).between(*cuts)) if cuts else df.filter(F.lit(False))


def residuals(predicted: DataFrame, target: str = "delay_min") -> DataFrame:
    return predicted.withColumn("residual", F.col(target) - F.col("prediction"))


def mean_delay(df: DataFrame, by: str = "line", col: str = "delay_min") -> DataFrame:
    return df.groupBy(by).agg(F.avg(col).alias("mean_delay"), F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("mean_delay"), by)


def describe_target(df: DataFrame, col: str = "delay_min") -> DataFrame:
    """One row: count, mean, standard deviation, least, quartiles and largest."""
    quartiles = exact_quantiles(df, F.col(col), [0.25, 0.5, 0.75]) or [None] * 3
    between = [F.lit(q).cast("double").alias(n) for q, n in zip(quartiles, ("q25", "median", "q75"), strict=True)]
    return df.agg(F.count(col).alias("n_rows"), F.avg(col).alias("mean"), F.stddev(col).alias("std"), F.min(col).alias("min"), *between, F.max(col).alias("max"))


def histogram(df: DataFrame, col: str, bins: int = 60) -> DataFrame:
    """(bin, n_rows) of equal widths between the least and largest value, the last bin closed."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()  # two numbers
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n_rows long")
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, in one pass over the rows."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    both = one.select(F.explode(cells).alias("c")).select("c.*")
    ones = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, r double")
    return both.union(both.select("b", "a", "r")).union(ones)


def reference_profile(train: DataFrame, cols: list[str], pinned: dict[str, float], approx: bool = False) -> DataFrame:
    """One row of medians, some columns pinned to a value. Exact, by brackets that no task orders many
    values of; ``approx`` reads the rows once and keeps sketches instead."""
    free = [c for c in cols if c not in pinned]
    if approx:
        medians = train.agg(F.lit(0).alias("__one"), *[F.percentile_approx(c, 0.5).cast("double").alias(c) for c in free])
    else:
        medians = grouped_medians(train, [], {c: F.col(c) for c in free})
    return medians.select(*[F.lit(float(pinned[c])).alias(c) if c in pinned else F.col(c) for c in cols])


def entity_profiles(train: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Medians of ``cols`` per entity, exact as in :func:`reference_profile`, or from sketches (``approx``)."""
    if approx:
        return train.groupBy("entity").agg(*[F.percentile_approx(c, 0.5).cast("double").alias(c) for c in cols])
    return grouped_medians(train, ["entity"], {c: F.col(c) for c in cols})
