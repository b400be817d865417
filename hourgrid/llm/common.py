"""Helpers shared by the text operators.

Column names that begin with two underscores are reserved for the operators'
own use; every other name may occur in the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise

#: Rows up to which a side of a join is broadcast after it has been counted.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to have at most ``rows``
    rows (of bounded width), else unchanged, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def only(df: DataFrame, keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``df`` that join the one column of ``keys``, before they are shuffled, if
    ``keys`` has been counted to have at most ``rows`` rows; else ``df`` as it is."""
    return df.join(F.broadcast(keys), keys.columns[0], "left_semi") if keys.limit(rows + 1).count() <= rows else df


def byte_slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``size`` bytes of a text or binary column; a longer value
    is a slice of its own."""
    lo, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > lo and held + (n or 0) > size:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += (n or 0) + 64
    if lo < batch.num_rows:
        yield batch.slice(lo)


def _plain(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def lower_word(word: Column) -> Column:
    """A-Z to a-z in one word; other characters stay."""
    return F.when(_plain(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; other characters stay. Only words with characters beyond ASCII take the
    slower way through ``translate``."""
    words = F.transform(F.split(col, " ", -1), lower_word)
    return F.when(_plain(col), F.lower(col)).otherwise(F.array_join(words, " "))


def blank_words(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D; null has none. A split
    at a plain space needs no regular expression."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def row_key(*cols: Column) -> Column:
    """A 128-bit key of a row's identity and content. Rows that agree in all
    ``cols`` share it, and get equal results. Nulls count as a value."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.md5(F.concat_ws("\x1f", *parts))


def unit_hash(*parts: Column | str) -> Column:
    """A reproducible uniform number in (0, 1) from 52 bits of an MD5 of ``parts``."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def crc_fold(col: Column) -> Column:
    """crc32 of an id as text, modulo 5; null ids count as 0."""
    return F.coalesce(F.crc32(col.cast("string")) % 5, F.lit(0)).cast("int")


def budget_cut(rows: DataFrame, group: str, key: str, tie: str, size: str, budgets: DataFrame, budget: str) -> DataFrame:
    """Per group, where rows in ascending (``key``, ``tie``) order use up a budget of ``size``.

    Returns ``__g``, ``__edge`` (long), ``__cut`` (struct of key and tie, or null), ``__copies``
    and ``__fit`` (long): a row is within the budget if :func:`within` says so, but of the
    ``__copies`` rows at the cut itself only ``__fit`` are. A row fits if that leaves the
    total nearer to the budget. Rows that agree in key and tie must agree in size.

    Keys are dealt to narrow value bins. Bin totals, a few thousand per group, are summed
    in order; only keys of the one bin in which the budget runs out are sorted, each with
    the number of its rows. So no group is sorted as a whole, even if it has a third of
    all rows. ``key`` must be on a log-scale, a unit makes 256 bins.
    """
    ordered = Window.partitionBy("__g")
    bins = rows.groupBy(F.col(group).alias("__g"), _bin(F.col(key)).alias("__bin")).agg(F.sum(size).alias("__sum"))
    bins = bins.withColumn("__end", F.sum("__sum").over(ordered.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)))
    budgets = budgets.select(F.col(group).alias("__g2"), F.col(budget).alias("__budget"))
    edges = bins.join(small(budgets), F.col("__g").eqNullSafe(F.col("__g2"))).filter(F.col("__end") > F.col("__budget"))
    edges = edges.groupBy("__g").agg(F.min_by(F.struct("__bin", F.col("__end") - F.col("__sum"), "__budget"), "__bin").alias("__e"))
    edges = materialise(edges.select("__g", *[F.col("__e").getField(f).alias(n) for f, n in (("__bin", "__edge"), ("col2", "__start"), ("__budget", "__budget"))]))
    inside = rows.select(F.col(group).alias("__g1"), F.struct(F.col(key).alias("key"), F.col(tie).alias("tie")).alias("__key"), F.col(size).alias("__size"))
    inside = inside.join(small(edges), F.col("__g1").eqNullSafe(F.col("__g")) & (_bin(F.col("__key.key")) == F.col("__edge")))
    inside = inside.groupBy("__g", "__start", "__budget", "__key", "__size").agg(F.count(F.lit(1)).alias("__copies"))
    all_ = F.col("__size") * F.col("__copies")
    before = F.col("__start") + F.sum(all_).over(ordered.orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)) - all_
    left = F.col("__budget") - before - F.col("__size") / 2
    fit = F.when(left < 0, 0).when(F.col("__size") > 0, F.least(F.floor(left / F.col("__size")) + 1, F.col("__copies"))).otherwise(F.col("__copies"))
    last = F.max(F.when(F.col("__fit") > 0, F.struct("__key", "__copies", "__fit"))).alias("__last")
    cuts = inside.withColumn("__fit", fit).groupBy(F.col("__g").alias("__g3")).agg(last)
    named = [F.col("__last").getField(f).alias(n) for f, n in (("__key", "__cut"), ("__copies", "__copies"), ("__fit", "__fit"))]
    return edges.join(cuts, F.col("__g").eqNullSafe(F.col("__g3")), "left").select("__g", "__edge", *named)


def _bin(key: Column) -> Column:
    return F.floor(key * 256)


def within(key: Column, tie: Column) -> Column:
    """Whether a row joined to its group's :func:`budget_cut` is within the budget; a
    group without a cut is within as a whole."""
    at = F.struct(key.alias("key"), tie.alias("tie"))
    return F.col("__edge").isNull() | (_bin(key) < F.col("__edge")) | ((_bin(key) == F.col("__edge")) & F.coalesce(at <= F.col("__cut"), F.lit(False)))
