"""Column expressions. Times are naive (timestamp_ntz); the session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourgrid.policy import Policy


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", strip(col))


def naive_timestamp(text: Column) -> Column:
    """An ISO time without offset, cut to seconds; null for anything else."""
    offset = text.rlike(r"[T ].*(?:[Zz]|[+-]\d\d(?::?\d\d(?::?\d\d)?)?)\s*$")
    return F.when(~offset, F.date_trunc("second", strip(text).try_cast("timestamp_ntz")).cast("timestamp_ntz"))


def whole_number(text: Column) -> Column:
    """A decimal integer as long; null for anything else."""
    return F.when(strip(text).rlike(r"^[+-]?\d+$"), strip(text).try_cast("long"))


def hour_floor(col: Column) -> Column:
    return F.date_trunc("hour", col).cast("timestamp_ntz")


def hour_ceil(col: Column) -> Column:
    return F.when(hour_floor(col) == col, col).otherwise(hour_floor(col) + F.expr("interval 1 hour"))


def date_hour(date: Column, hour: Column) -> Column:
    """A date and an hour of the day as a naive time."""
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), hour, F.lit(0), F.lit(0))


def month_key(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def epoch_hours(col: Column) -> Column:
    return F.floor(F.unix_timestamp(col.cast("timestamp")) / 3600)


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))) / F.lit(3600.0)


def pipe_tokens(col: Column, upper: bool = False) -> Column:
    """The distinct non-blank tokens of a pipe-delimited cell, in one case, sorted."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), r"\|"), lambda t: (F.upper if upper else F.lower)(strip(t)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != "")))


def fold_alias(col: Column, policy: Policy) -> Column:
    """The entity that an alias stands for; other values stay."""
    if not policy.aliases:
        return col
    table = F.create_map(*[F.lit(x) for pair in sorted(policy.aliases.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, col), col)


def entities_of(col: Column, policy: Policy) -> Column:
    """The distinct canonical entities of an affected cell, sorted."""
    known = F.array(*[F.lit(e) for e in policy.canonical])
    folded = F.transform(pipe_tokens(col, upper=True), lambda t: fold_alias(t, policy))
    return F.array_sort(F.array_distinct(F.filter(folded, lambda t: F.array_contains(known, t))))


def has_any(tokens: Column, wanted: tuple[str, ...]) -> Column:
    """Whether an array of tokens holds one of ``wanted``."""
    return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(False)


def stable_rank(*cols: Column) -> Column:
    """A reproducible order key: SHA-256 of the values joined by bars."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)
