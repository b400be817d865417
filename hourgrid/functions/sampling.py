"""Bounded samples that are the same in every run and for any order of rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 40


def hash_sample(df: DataFrame, max_rows: int, keys: list[str]) -> DataFrame:
    """At most ``max_rows`` rows of ``df``, those of the smallest hash of ``keys`` (ties by key).

    Rows are counted first, and of many rows only those under a hash bound that leaves a
    few more than wanted are ordered, so no task orders more than about the sample."""
    df = df.withColumn("__place", F.pmod(F.xxhash64(*keys), F.lit(_SPACE)))
    n = df.count()
    few = df
    if n > 2 * max_rows:
        bound = math.ceil(_SPACE * (max_rows + 10 * math.sqrt(max_rows) + 100) / n)
        few = df.filter(F.col("__place") < bound)
        if few.limit(max_rows).count() < max_rows:  # keys repeat: hashes are not spread
            few = df
    return few.orderBy("__place", *keys).limit(max_rows).drop("__place")
