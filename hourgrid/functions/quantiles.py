"""Exact quantiles of columns, whole or by group, whatever the number of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise, small

#: Distinct values that one task may order.
ONE_TASK = 100_000
#: Brackets that one pass deals the values of a group to.
BRACKETS = 64

_CELL = ["k", "c", "b"]


def _refined(part: DataFrame, want: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass over the cells that hold too many values: a mergeable sketch cuts each to brackets, exact counts tell the
    bracket of every place, and brackets with a place become cells of their own. All groups, columns and places share the pass."""
    inside, outside = (part.join(small(big), _CELL, how) for how in ("left_semi", "left_anti"))
    cuts = F.percentile_approx("v", F.lit([i / BRACKETS for i in range(1, BRACKETS)]), 100 * BRACKETS)
    edges = materialise(inside.groupBy(*_CELL).agg(F.array_sort(F.array_distinct(cuts)).alias("edges")))
    # Values in (edge before, edge]; the outermost brackets are open.
    dealt = inside.join(small(edges), _CELL).withColumn("i", F.size(F.filter("edges", lambda e: e < F.col("v"))).cast("long"))
    upto = Window.partitionBy(*_CELL).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # BRACKETS rows at most
    sums = dealt.groupBy(*_CELL, "i").agg(F.sum("n").alias("s")).withColumn("before", F.sum("s").over(upto) - F.col("s"))
    found = want.join(small(materialise(sums)), _CELL).filter((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("s")))
    deeper = (F.col("b") * BRACKETS + F.col("i") + 1).alias("b")
    moved = materialise(found.select("k", "c", "b", "i", "place", (F.col("left") - F.col("before")).alias("left")))
    kept = dealt.join(small(moved.select(*_CELL, "i").distinct()), [*_CELL, "i"], "left_semi").select("k", "c", deeper, "v", "n")
    want = want.join(small(big), _CELL, "left_anti").unionByName(moved.select("k", "c", deeper, "place", "left"))
    return materialise(outside.unionByName(kept)), materialise(want)


def _values_at(counts: DataFrame, places: DataFrame, one_task: int) -> DataFrame:
    """(k, c, place, v): the values at places (from 0) of the rows that ``counts`` (k, c, v, n) stands for.

    A cell is a group and column, later a bracket of one. Cells are cut until each has at most ``one_task`` values;
    then a task sorts a cell. The number of jobs depends on the depth of cutting only."""
    part, want = counts.withColumn("b", F.lit(0).cast("long")), places.select("k", "c", F.lit(0).cast("long").alias("b"), "place", F.col("place").alias("left"))
    while True:
        big = part.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > one_task).select(*_CELL)
        if not big.limit(1).count():
            break
        part, want = _refined(part, want, materialise(big))
    upto = F.sum("n").over(Window.partitionBy(*_CELL).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # one_task rows at most
    ordered = part.withColumn("upto", upto)
    found = ordered.join(want, _CELL).filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
    return found.select("k", "c", "place", "v")


def _counted(df: DataFrame, keys: list[str], columns: dict[str, Column], weight: Column | None) -> DataFrame:
    """(k, c, v, n): distinct values of each group (a struct of ``keys``) and column (its number), with rows."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), c.cast("double").alias("v")) for i, c in enumerate(columns.values())])
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("k"), F.explode(cells).alias("x"), (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    return materialise(rows.select("k", "x.c", "x.v", "w").filter("v is not null").groupBy("k", "c", "v").agg(F.sum("w").alias("n")))


def _between(counts: DataFrame, probs: list[float], one_task: int) -> DataFrame:
    """(k, c, p, value): quantiles between the two rows next to a place."""
    asked = counts.groupBy("k", "c").agg(F.sum("n").alias("rows")).withColumn("p", F.explode(F.lit([float(p) for p in probs])))
    at = F.col("p") * (F.col("rows") - 1)
    asked = materialise(asked.select("k", "c", "p", at.alias("at"), F.floor(at).alias("lo"), F.ceil(at).alias("hi")))
    places = asked.select("*", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("place"))
    found = places.join(_values_at(counts, places.select("k", "c", "place").distinct(), one_task), ["k", "c", "place"])
    low, high = (F.max(F.when(F.col("place") == F.col(n), F.col("v"))).alias(f"v_{n}") for n in ("lo", "hi"))
    both = found.groupBy("k", "c", "p", "at", "lo", "hi").agg(low, high)
    mixed = (F.col("hi") - F.col("at")) * F.col("v_lo") + (F.col("at") - F.col("lo")) * F.col("v_hi")
    return both.select("k", "c", "p", F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo")).otherwise(mixed).alias("value"))


def grouped_quantiles(df: DataFrame, keys: list[str], columns: dict[str, Column], probs: list[float], weight: Column | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(``keys``, column, p, value): exact quantiles (linear between rows) of every column in every group; ``weight`` is
    how many rows a row stands for. Nulls are left out, and a group and column without values has no row.

    Rows are counted per group, column and distinct value, combined before they are shuffled. Groups of more than ``one_task`` distinct values are cut
    to brackets, all together, until no task orders more than that."""
    found = _between(_counted(df, keys, columns, weight), probs, one_task)
    name = F.element_at(F.lit(list(columns)), F.col("c") + 1).alias("column")
    return found.select(*[F.col(f"k.{k}").alias(k) for k in keys], name, "p", "value")


def grouped_medians(df: DataFrame, keys: list[str], columns: dict[str, Column], one_task: int = ONE_TASK) -> DataFrame:
    """One row per group with the median of every column, null where it has no values."""
    found = _between(_counted(df, keys, columns, None), [0.5], one_task)
    wide = found.groupBy("k").agg(*[F.max(F.when(F.col("c") == i, F.col("value"))).alias(f"m{i}") for i in range(len(columns))])
    medians = [F.col(f"m{i}").alias(n) for i, n in enumerate(columns)]
    if not keys:
        return wide.agg(*[F.max(f"m{i}").alias(n) for i, n in enumerate(columns)])
    groups = df.select(F.struct(*keys).alias("k")).distinct()
    return groups.join(wide, "k", "left").select(*[F.col(f"k.{k}").alias(k) for k in keys], *medians)


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], weight: Column | None = None, one_task: int = ONE_TASK) -> list[float]:
    """Quantiles of ``value`` (linear between rows; ``weight`` is how many rows a row stands for).
    Nulls are left out; without values the list is empty.

    Rows are counted per distinct value first. If these are few, one aggregate orders them;
    else all places are looked for together, see :func:`grouped_quantiles`."""
    counts = _counted(df, [], {"v": value}, weight)
    if counts.limit(one_task + 1).count() <= one_task:
        listed = ", ".join(f"{p!r}D" for p in probs)
        return counts.agg(F.expr(f"percentile(v, array({listed}), n)").alias("q")).first()["q"] or []
    found = {r["p"]: r["value"] for r in _between(counts, probs, one_task).collect()}  # as many as probs
    return [found[float(p)] for p in probs]
