"""Trailing frames and running sums that don't need a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.columns import epoch_hours
from hourgrid.functions.storage import materialise

#: Hours of a history chunk: a year. Frames reach back at most that far.
CHUNK_HOURS = 8760
#: Rows of a range that one task orders.
BIN_ROWS = 100_000


def trailing_sum(prefix: str, k: int, order: Window) -> Column:
    """The sum of the last ``k`` rows before the current one, from an inclusive running sum in
    column ``prefix``; null on the first row. One ``lag`` per frame, whatever its length."""
    return F.lag(prefix, 1).over(order) - F.coalesce(F.lag(prefix, k + 1).over(order), F.lit(0))


def trailing_mean(prefix: str, row: str, k: int, order: Window) -> Column:
    """The mean over the same frame, of as many rows as there are; ``row`` counts rows from 1."""
    return trailing_sum(prefix, k, order) / F.least(F.col(row) - 1, F.lit(k)).cast("double")


def with_halo(df: DataFrame, hour: str, halo: int, chunk: int = CHUNK_HOURS) -> DataFrame:
    """Rows of an hourly series dealt to chunks of time (``__chunk``); the last ``halo`` hours
    before a chunk are repeated in it (``__halo``). Frames of up to ``halo`` rows can then be
    evaluated per chunk, so a long series spreads over many tasks."""
    if halo > chunk:
        raise ValueError("a frame may not be longer than a chunk")
    at = epoch_hours(F.col(hour))
    own = F.floor(at / chunk)
    after = F.floor((at + halo) / chunk)
    return df.withColumn("__own", own).withColumn("__chunk", F.explode(F.array_distinct(F.array(own, after)))).withColumn("__halo", F.col("__chunk") != F.col("__own")).drop("__own")


def ranged(df: DataFrame, by: list[str], bins: int) -> DataFrame:
    """``df`` written in ``bins`` ranges of about equal counts in the order of columns ``by``, with the number of each row's
    range as ``__bin``. Edges come from a sample; rows that agree in all of ``by`` share a range."""
    return materialise(df.repartitionByRange(bins, *by).withColumn("__bin", F.spark_partition_id()))


def running_totals(df: DataFrame, key: str, sums: list[str], descending: bool = False, bins: int | None = None, within: list[str] = ()) -> DataFrame:
    """Inclusive running sums of columns ``sums`` in the order of ``key`` (distinct per ``within``), as ``cum_``
    columns.

    Rows are dealt to ``bins`` ranges of about equal counts (default: :data:`BIN_ROWS` each), whatever the
    distribution of keys; totals of ranges give each its start, and sums run inside ranges. Few rows are one range."""
    rows = materialise(df)
    bins = bins or -(-rows.count() // BIN_ROWS)
    order = F.desc(key) if descending else F.asc(key)
    if bins <= 1:
        upto = Window.partitionBy(*(within or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # BIN_ROWS at most
        return rows.withColumns({f"cum_{c}": F.sum(c).over(upto) for c in sums})
    return _carried(ranged(rows, [*within, key], bins), list(within), [order], {f"cum_{c}": ("sum", c) for c in sums}, descending)


def _carried(dealt: DataFrame, keys: list[str], order: list[Column], runs: dict[str, tuple[str, str]], descending: bool = False) -> DataFrame:
    """Running values per ``keys`` of rows dealt to ordered ranges (``__bin``): what a range's rows sum or reach, and
    what all ranges before it do. ``runs`` maps a new column to ("sum" or "max", column)."""
    folds = {"sum": F.sum, "max": F.max}
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("__bin") if descending else F.asc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "__bin").agg(*[folds[how](c).alias(f"__of_{name}") for name, (how, c) in runs.items()])
    starts = totals.select(*keys, "__bin", *[folds[how](f"__of_{name}").over(before).alias(f"__start_{name}") for name, (how, _) in runs.items()])
    upto = Window.partitionBy(*keys, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({name: folds[how](c).over(upto) for name, (how, c) in runs.items()}).join(starts, [*keys, "__bin"])
    return local.select(*[c for c in dealt.columns if c != "__bin"], *[both[how](F.col(name), F.col(f"__start_{name}")).alias(name) for name, (how, _) in runs.items()])


def running_in_order(df: DataFrame, keys: list[str], order: list[str], runs: dict[str, tuple[str, str]]) -> DataFrame:
    """Running sums and maxima per ``keys`` (not null) in ``order`` by plain windows: a group is in one task."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: {"sum": F.sum, "max": F.max}[how](c).over(upto) for name, (how, c) in runs.items()})


def running_in_ranges(df: DataFrame, keys: list[str], order: list[str], runs: dict[str, tuple[str, str]], bins: int) -> DataFrame:
    """The same for groups of very many rows: these are dealt to ``bins`` ranges in the order of keys and
    ``order``, so a group spreads over many tasks, and each range starts from what those before it reach."""
    return _carried(ranged(df, [*keys, *order], bins), keys, [F.col(c) for c in order], runs)
