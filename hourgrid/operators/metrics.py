"""Splits, and how well scores rank and separate labels. Tables of scores have a score
column (0 to 1) and a 0/1 label; each is folded to distinct scores before any ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.frames import running_totals
from hourgrid.functions.quantiles import exact_quantiles


def chronological_split(df: DataFrame, col: str = "hour", low: float = 0.70, high: float = 0.85) -> DataFrame:
    """Adds ``split``: train, val or test by two row quantiles (linear) of a time column. Times
    are counted first, so the exact quantiles come from distinct times."""
    at = F.unix_timestamp(F.col(col).cast("timestamp"))
    counts = df.groupBy(at.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.agg(F.expr(f"percentile(t, array({low}D, {high}D), n)").alias("c")).first()["c"]  # two numbers
    if cuts is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    return df.withColumn("split", F.when(at <= cuts[0], "train").when(at <= cuts[1], "val").otherwise("test"))


def nearest_split(df: DataFrame, col: str, q: float = 0.8) -> DataFrame:
    """Adds ``split``: train up to the value at the row nearest to quantile ``q`` (halves to the
    even row), test after it. Null values are in neither."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct value
    upto = counts.withColumns({"__upto": F.sum("n").over(order), "__all": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    cut = upto.filter(F.col("__upto") > F.bround((F.col("__all") - 1) * F.lit(q), 0)).agg(F.min(col)).first()[0]
    return df.withColumn("split", F.when(F.col(col) <= F.lit(cut), "train").when(F.col(col) > F.lit(cut), "test"))


def split_summary(df: DataFrame, time_col: str = "hour", label: str = "label") -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("double")).alias("positive_rate"), F.to_date(F.min(time_col)).alias("first_date"), F.to_date(F.max(time_col)).alias("last_date"))


def baseline_scores(rows: DataFrame, rate: str = "rate_prior_30d") -> DataFrame:
    """The trailing rate as the score, 0 without history."""
    return rows.withColumn("score", F.coalesce(rate, F.lit(0.0)))


def score_groups(scores: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct scores with positives and negatives."""
    y = F.col(label)
    return scores.groupBy(*by, F.col(score).alias("p")).agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def threshold_scan(scores: DataFrame, low: int = 5, high: int = 95) -> DataFrame:
    """(threshold, f1) for the thresholds i/100. Scores are counted by the number of
    thresholds that they reach, so what is ordered is a table of as many rows."""
    cuts = [i / 100 for i in range(low, high + 1)]
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("p")))
    bins = score_groups(scores).groupBy(at.alias("i")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = scores.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("i")).join(bins, "i", "left").fillna(0)
    up = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    df = every.withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up), "all_pos": F.sum("pos").over(Window.partitionBy(F.lit(0)))})
    return df.filter("i > 0").select(F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("i")).alias("threshold"), _f1(F.col("tp"), F.col("fp"), F.col("all_pos") - F.col("tp")).alias("f1"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """The threshold of best F1 (the lowest of equals) and its F1."""
    return threshold_scan(scores).orderBy(F.desc("f1"), "threshold").limit(1)


def confusion_metrics(scores: DataFrame, threshold: Column | float) -> DataFrame:
    """One row: counts at a threshold, accuracy, precision, recall and F1 (0 where undefined)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, y = F.col("score") >= t, F.col("label") == 1
    count = lambda c: F.count(F.when(c, 1))
    df = scores.agg(count(hit & y).alias("tp"), count(hit & ~y).alias("fp"), count(~hit & y).alias("fn"), count(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.withColumns({"accuracy": zero(tp + tn, tp + fp + fn + tn), "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": _f1(tp, fp, fn)})


def ranking_metrics(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Average precision (steps, not trapezia) and ROC-AUC (ties count half), per ``by``. The
    ordering runs in bins of the score, never in one task."""
    df = running_totals(score_groups(scores, by=by), "p", ["pos", "neg"], descending=True, within=list(by))
    ap = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / F.lit(2.0)))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(ap, n_pos), F.lit(0.0)).alias("average_precision"), F.try_divide(area, n_pos * n_neg).alias("roc_auc"), n_pos.alias("n_pos"), n_neg.alias("n_neg"))


def pr_curve(scores: DataFrame) -> DataFrame:
    """(place, threshold, precision, recall) per distinct score in ascending order, and the end
    point of recall 0 and precision 1."""
    groups = score_groups(scores).withColumn("one", F.lit(1))
    df = running_totals(groups, "p", ["pos", "neg", "one"], descending=True)
    total = groups.agg(F.sum("pos").alias("n_pos"), F.count(F.lit(1)).alias("n_all")).withColumn("__k", F.lit(1))  # one row
    df = df.withColumn("__k", F.lit(1)).join(F.broadcast(total), "__k")
    points = df.select((F.col("n_all") - F.col("cum_one")).alias("place"), F.col("p").alias("threshold"), (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"), F.coalesce(F.try_divide("cum_pos", "n_pos"), F.lit(1.0)).alias("recall"))
    end = total.select(F.col("n_all").alias("place"), F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def thin_curve(curve: DataFrame, n: int = 200) -> DataFrame:
    """At most ``n`` evenly spaced points by ``place`` (0 to m-1), both ends included: the places
    floor(i (m-1) / (n-1))."""
    m = curve.agg(F.max("place").alias("__m")).withColumn("__k", F.lit(1))  # one row
    df = curve.withColumn("__k", F.lit(1)).join(F.broadcast(m), "__k").drop("__k")
    last, r = F.col("__m"), F.col("place")
    i = F.ceil(r * (n - 1) / F.greatest(last, F.lit(1)))
    return df.filter((last < n) | (F.floor(i * last / (n - 1)) == r) | (F.floor((i - 1) * last / (n - 1)) == r) | (F.floor((i + 1) * last / (n - 1)) == r)).drop("__m")


def calibration(scores: DataFrame, bins: int = 12) -> DataFrame:
    """Mean score and observed rate in quantile bins; a score at an edge is in the lower bin,
    empty bins drop out."""
    groups = score_groups(scores).withColumn("n", F.col("pos") + F.col("neg"))
    edges = exact_quantiles(groups, F.col("p"), [i / bins for i in range(1, bins)], F.col("n"))
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < F.col("p")))
    n = F.sum("n")
    return groups.groupBy(at.alias("bin")).agg(n.alias("n_rows"), (F.sum(F.col("p") * F.col("n")) / n).alias("mean_score"), (F.sum("pos") / n).alias("observed_rate"))


def score_histogram(scores: DataFrame, bins: int = 1000) -> DataFrame:
    """(bin, pos, neg) for every bin of [0, 1]; bins are closed on the left, the last on both
    sides; scores are clipped. Edges are i x (1 / bins) in floating point."""
    step = 1.0 / bins
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    b = F.floor(p * bins)
    b = F.when(p >= (b + 1) * F.lit(step), b + 1).when(p < b * F.lit(step), b - 1).otherwise(b)
    counts = score_groups(scores).groupBy(F.least(b, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0)


def threshold_table(hist: DataFrame, bins: int = 1000) -> DataFrame:
    """Per bin as a threshold: counts at or above it, precision, recall, F1, and lift over the
    base rate. One row per bin is ordered."""
    up, every = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0))
    df = hist.withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up), "n_pos": F.sum("pos").over(every), "n_neg": F.sum("neg").over(every)})
    tp, fp, n_pos, n_neg = (F.col(c) for c in ("tp", "fp", "n_pos", "n_neg"))
    precision = F.try_divide(tp, tp + fp)
    return df.select("bin", (F.col("bin") / float(bins)).alias("threshold"), "tp", "fp", precision.alias("precision"), F.try_divide(tp, n_pos).alias("recall"), _f1(tp, fp, n_pos - tp).alias("f1"), F.try_divide(precision, F.try_divide(n_pos, n_pos + n_neg)).alias("lift"))


def nearby_rates(hist: DataFrame, bins: int = 1000, least: int = 300, width: int = 15) -> DataFrame:
    """(bin, n_near, pos_near, rate, half_width) per bin: what was observed for scores within
    ``width`` bins, doubled until there are ``least`` rows or the whole range is seen."""
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row per bin
    cum = hist.select("bin", F.sum("pos").over(up).alias("cp"), F.sum(F.col("pos") + F.col("neg")).over(up).alias("cn"))
    widths = [width << j for j in range(32) if width << j <= bins]
    ask = hist.select("bin", F.explode(F.array(*[F.lit(w) for w in widths])).alias("w"))
    ask = ask.withColumns({"hi": F.least(F.col("bin") + F.col("w"), F.lit(bins - 1)), "lo": F.col("bin") - F.col("w") - 1})
    low = cum.select(F.col("bin").alias("lo"), F.col("cp").alias("lp"), F.col("cn").alias("ln"))
    df = ask.join(cum.withColumnRenamed("bin", "hi"), "hi").join(low, "lo", "left").fillna(0, ["lp", "ln"])
    df = df.select("bin", "w", (F.col("cp") - F.col("lp")).alias("pos"), (F.col("cn") - F.col("ln")).alias("n"))
    df = df.groupBy("bin").agg(F.min(F.when((F.col("n") >= least) | (F.col("w") == widths[-1]), F.struct("w", "n", "pos"))).alias("r"))
    return df.select("bin", F.col("r.n").alias("n_near"), F.col("r.pos").alias("pos_near"), F.coalesce(F.try_divide("r.pos", "r.n"), F.lit(0.0)).alias("rate"), (F.col("r.w") / float(bins)).alias("half_width"))


def nearby_rate(hist: DataFrame, scores: DataFrame, bins: int = 1000) -> DataFrame:
    """``scores`` with the observed rate near each; one row per bin is broadcast."""
    at = F.least(F.greatest(F.floor(F.col("score") * bins + 0.5), F.lit(0)), F.lit(bins - 1)).cast("int")
    return scores.withColumn("bin", at).join(F.broadcast(nearby_rates(hist, bins)), "bin").drop("bin")
