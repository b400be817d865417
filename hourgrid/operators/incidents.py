"""From updates to the first qualifying start of each incident and entity.

Updates carry their tokens and entities as arrays, so one shuffle by event serves instance
numbers, the planned flag and the first start."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.columns import entities_of, fold_alias, has_any, pipe_tokens
from hourgrid.functions.frames import running_in_order, running_in_ranges
from hourgrid.functions.storage import materialise, small
from hourgrid.policy import Policy

#: Updates from which an event's series is dealt to several tasks.
HOT_ROWS = 1_000_000


def normalize_updates(updates: DataFrame) -> DataFrame:
    """Adds the trimmed lower-case agency and status, and the trimmed affected cell."""
    return updates.withColumns({"agency_normalized": F.lower(F.trim("agency")), "status_normalized": F.lower(F.trim("status_label")), "affected": F.trim("affected")})


def explode_tokens(df: DataFrame, id_col: str, col: str, upper: bool = False) -> DataFrame:
    """(``id_col``, token): the distinct tokens of a pipe-delimited cell."""
    return df.select(id_col, F.explode(pipe_tokens(F.col(col), upper)).alias("token"))


def map_entities(tokens: DataFrame, policy: Policy, id_col: str = "update_id") -> DataFrame:
    """(``id_col``, entity): canonical entities of tokens after aliases, each once per id."""
    known = F.broadcast(policy.entity_table(tokens.sparkSession))  # a constant of the policy
    return tokens.select(id_col, fold_alias(F.col("token"), policy).alias("entity")).join(known, "entity", "left_semi").select(id_col, "entity").distinct()


def unmapped_entities(tokens: DataFrame, policy: Policy, id_col: str = "update_id") -> DataFrame:
    """(``id_col``, token): tokens that stand for no canonical entity."""
    known = F.broadcast(policy.entity_table(tokens.sparkSession))
    folded = tokens.withColumn("__e", fold_alias(F.col("token"), policy))
    return folded.join(known, folded["__e"] == known["entity"], "left_anti").select(id_col, "token")


def hot_events(updates: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int] | None:
    """(``event_id``) of events with more than ``hot_rows`` updates, and their updates' number; None if there are
    none, as in any table of no more rows than that, which is counted first. A hot event's series is dealt to several
    tasks."""
    if updates.count() <= hot_rows:
        return None
    hot = materialise(updates.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows))
    n = hot.agg(F.sum("n")).first()[0]
    return (hot.select("event_id"), n) if n else None


def _by_heat(updates: DataFrame, hot_rows: int, plain: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``plain`` for the updates of ordinary events, ``spread`` (rows, number of ranges) for those of hot ones."""
    found = hot_events(updates, hot_rows)
    if found is None:
        return plain(updates)
    hot, n = found
    cold, warm = (updates.join(small(hot), "event_id", how).select(*updates.columns) for how in ("left_anti", "left_semi"))
    # Two ranges at least for each hot_rows: an event with so many is never whole in one.
    return plain(cold).unionByName(spread(warm, 2 * -(-n // hot_rows)))


def _numbered(df: DataFrame, run: Callable[[DataFrame, list[str], list[str], dict], DataFrame]) -> DataFrame:
    starts = df.withColumn("__starts", F.when(F.col("revision") == 0, 1).otherwise(0))
    df = run(starts, ["event_id"], ["published_at", "update_id"], {"instance_seq": ("sum", "__starts")}).drop("__starts")
    return df.withColumn("instance_id", F.concat_ws(":", F.col("event_id").cast("string"), F.col("instance_seq").cast("string")))


def event_instances(updates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``instance_seq``, the running count of revision 0 per event in order of time and
    id, and ``instance_id`` as event:seq. Updates before any revision 0 have 0. Events of more than ``hot_rows`` updates are
    counted in ranges of time by several tasks."""
    return _by_heat(updates, hot_rows, lambda df: _numbered(df, running_in_order), lambda df, bins: _numbered(df, partial(running_in_ranges, bins=bins)))


def flag_updates(updates: DataFrame, policy: Policy) -> DataFrame:
    """Adds 0/1 ``is_planned`` and ``is_significant`` from the status tokens; updates without
    tokens have 0."""
    tokens = pipe_tokens(F.col("status_label"))
    return updates.withColumns({"is_planned": has_any(tokens, policy.planned).cast("int"), "is_significant": has_any(tokens, policy.significant).cast("int")})


def _planned(flagged: DataFrame, run: Callable[[DataFrame, list[str], list[str], dict], DataFrame]) -> DataFrame:
    return run(flagged, ["event_id", "instance_seq"], ["published_at", "revision", "update_id"], {"planned_so_far": ("max", "is_planned")})


def planned_so_far(flagged: DataFrame) -> DataFrame:
    """Adds 0/1 ``planned_so_far``: whether this or an earlier update of the instance, in order
    of time, revision and id, is planned. Distributed by event, as instance numbers are."""
    return _planned(flagged, running_in_order)


def timeline(updates: DataFrame, policy: Policy, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Updates with instance, flags and the planned flag so far; see :func:`event_instances` on hot events, whose
    planned flags run in ranges too."""

    def spread(df: DataFrame, bins: int) -> DataFrame:
        run = partial(running_in_ranges, bins=bins)
        return _planned(flag_updates(_numbered(df, run), policy), run)

    return _by_heat(updates, hot_rows, lambda df: planned_so_far(flag_updates(_numbered(df, running_in_order), policy)), spread)


def qualifying_updates(lines: DataFrame, policy: Policy) -> DataFrame:
    """One row per entity of each significant update that no planned one precedes."""
    rows = lines.filter((F.col("is_significant") == 1) & (F.col("planned_so_far") == 0))
    return rows.withColumn("entity", F.explode(entities_of(F.col("affected"), policy)))


def first_starts(qualifying: DataFrame) -> DataFrame:
    """The first qualifying update of each instance and entity, in order of time, revision and
    id. An aggregate, so groups fold before any shuffle; the event stays in the key and
    keeps the distribution of the steps before."""
    order = F.struct("published_at", "revision", "update_id")
    row = F.struct("update_id", "revision", "published_at", "status_label", "header", "instance_id")
    firsts = qualifying.groupBy("event_id", "instance_seq", "entity").agg(F.min_by(row, order).alias("__r"))
    return firsts.select(
        "__r.instance_id", "event_id", "entity", F.col("__r.update_id").alias("first_update_id"), F.col("__r.revision").alias("first_revision"),
        F.col("__r.published_at").alias("start_at"), F.col("__r.status_label").alias("first_status"), F.col("__r.header").alias("first_header"),
    )


def incident_starts(updates: DataFrame, policy: Policy) -> DataFrame:
    """The starts of all incidents of typed updates."""
    return first_starts(qualifying_updates(timeline(updates, policy), policy))
