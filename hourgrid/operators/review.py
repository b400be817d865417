"""A reproducible stratified sample for human review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.columns import entities_of, has_any, hour_floor, pipe_tokens, stable_rank
from hourgrid.functions.storage import materialise
from hourgrid.policy import Policy

POSITIVE, PLANNED, OTHER = "included_positive", "excluded_as_planned", "excluded_nonqualifying_status"


def event_flags(timeline: DataFrame, policy: Policy) -> DataFrame:
    """Whole-instance flags: any planned and any significant token. Instances without any
    token drop out."""
    tokens = pipe_tokens(F.col("status_label"))
    rows = timeline.filter(F.size(tokens) > 0)
    return rows.groupBy("event_id", "instance_seq", "instance_id").agg(F.max(has_any(tokens, policy.planned).cast("int")).alias("any_planned"), F.max(has_any(tokens, policy.significant).cast("int")).alias("any_significant"))


def exclusions(timeline: DataFrame, policy: Policy) -> DataFrame:
    """The first update per instance and entity, by time and id, of instances that are planned
    and significant, or neither."""
    flags = event_flags(timeline, policy).filter("any_planned = any_significant").select("event_id", "instance_seq", "any_planned")
    rows = timeline.join(flags, ["event_id", "instance_seq"]).withColumn("entity", F.explode(entities_of(F.col("affected"), policy)))
    row = F.struct("published_at", "status_label", F.coalesce("header", F.lit("")).alias("header"), "any_planned")
    firsts = rows.groupBy("event_id", "instance_id", "entity").agg(F.min_by(row, F.struct("published_at", "update_id")).alias("r"))
    stratum = F.when(F.col("r.any_planned") == 1, PLANNED).otherwise(OTHER)
    return firsts.select(stratum.alias("stratum"), F.lit(0).alias("assigned_label"), "instance_id", "event_id", "entity", hour_floor(F.col("r.published_at")).alias("hour"), "r.published_at", "r.status_label", "r.header")


def review_candidates(timeline: DataFrame, starts: DataFrame, policy: Policy) -> DataFrame:
    """Positive starts and excluded first updates. An instance and entity can be in a positive
    and an excluded stratum, since flags of exclusions look at the whole instance."""
    hits = starts.select(F.lit(POSITIVE).alias("stratum"), F.lit(1).alias("assigned_label"), "instance_id", "event_id", "entity", hour_floor(F.col("start_at")).alias("hour"), F.col("start_at").alias("published_at"), F.col("first_status").alias("status_label"), F.coalesce("first_header", F.lit("")).alias("header"))
    return hits.unionByName(exclusions(timeline, policy))


def quotas(n: int) -> dict[str, int]:
    """Half positives, a quarter planned, the rest other."""
    if n <= 0:
        raise ValueError("n must be positive")
    return {POSITIVE: n // 2, PLANNED: n // 4, OTHER: n - n // 2 - n // 4}


def review_sample(candidates: DataFrame, n: int, strict: bool = True) -> DataFrame:
    """The first rows of each stratum in the order of a stable hash, by quota. Candidates are
    read once: every task keeps the largest quota of each stratum before anything is shuffled (Spark does so for quotas of
    up to ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000). ``strict`` raises on short strata."""
    quota = quotas(n)
    ranked = candidates.withColumn("order_key", stable_rank(F.col("stratum"), F.col("instance_id"), F.col("entity")))
    ranked = ranked.withColumn("__place", F.row_number().over(Window.partitionBy("stratum").orderBy("order_key")))
    own = reduce(lambda case, s: case.when(F.col("stratum") == s, F.lit(quota[s])), list(quota)[1:], F.when(F.col("stratum") == POSITIVE, F.lit(quota[POSITIVE])))
    # The fixed bound is what is applied before the shuffle, the stratum's own after it.
    sample = ranked.filter(F.col("__place") <= max(quota.values())).filter(F.col("__place") <= own).drop("__place")
    if strict:
        sample = materialise(sample)
        if (found := sample.count()) < n:
            raise ValueError(f"{found} rows for a sample of {n}")
    return sample


def strata_counts(sample: DataFrame) -> DataFrame:
    return sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_rows"))
