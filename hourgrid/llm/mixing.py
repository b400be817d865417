"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise
from hourgrid.llm.common import blank_words, budget_cut, small, unit_hash, within

#: The mean length of the tokens of prose, with the blank after each.
PROSE = 6.0


def quality_weight(words: Column, text: Column) -> Column:
    """A document's quality, 0.1 to 1, from its text alone: Herdan's C, the logarithm of the number
    of distinct words by that of all words, which hardly depends on length and is near 0 for
    what is repeated on and on, times how near the mean length of words is to that of prose.
    A null or empty text has 0.1. Any other column can be given instead."""
    n, mean = F.size(words), F.char_length(text) / F.greatest(F.size(words), F.lit(1))
    varied = F.when(n > 1, F.log(F.size(F.array_distinct(words))) / F.log(n)).otherwise(F.lit(1.0))
    return F.coalesce(F.when(n > 0, F.greatest(varied / (F.lit(1.0) + F.abs(mean - PROSE) / PROSE), F.lit(0.1))), F.lit(0.1))


def cycle_weights(sources: DataFrame, source_col: str, weights: tuple[float, ...]) -> DataFrame:
    """(source, weight): ``weights`` dealt in turn to the distinct sources in code point
    order, null last. The table has one row per source, not per document."""
    order = Window.orderBy(F.col(source_col).asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights) + 1
    return sources.select(source_col).distinct().withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at))


def source_targets(sizes: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight): ``share`` of all sizes
    divided by weight, none above ``max_epochs`` times its source's size; what a source
    cannot take is divided again among the rest by weight.

    That division has a closed form: target = min(cap, level x weight). Sources are put in
    order of cap / weight; those whose caps are reached before the budget is spent are
    full, the others share what is left. One row per source is sorted here.
    """
    every = Window.partitionBy(F.lit(0))
    up = every.orderBy("__ratio", "__cap", "weight").rowsBetween(Window.unboundedPreceding, 0)
    df = sizes.withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    df = df.withColumns({"__goal": F.sum("source_size").over(every) * F.lit(float(share)), "__rest": F.sum("weight").over(every) - F.sum("weight").over(up), "__used": F.sum("__cap").over(up)})
    df = df.withColumn("__full", F.col("__used") + F.col("__ratio") * F.col("__rest") <= F.col("__goal"))
    level = (F.col("__goal") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("__full"), F.col("weight"))).over(every)
    return df.withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(level * F.col("weight"), F.col("__cap")))).drop("__cap", "__ratio", "__goal", "__rest", "__used", "__full")


def mix_sources(docs: DataFrame, weights: DataFrame | tuple[float, ...], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_epochs: int = 2, quality: Column | None = None, seed: str = "mix") -> DataFrame:
    """How often each document is taken so that sources reach their target weights.

    A source's target (see :func:`source_targets`) buys complete epochs first; the rest is
    an Efraimidis-Spirakis sample: documents in ascending order of -ln(u) / w, with u a
    seeded hash of the row and w its quality weight (default :func:`quality_weight`), up to
    the budget. The document at the budget's end is taken if that brings the sum nearer.

    ``weights`` is a table (source, weight > 0) or a tuple dealt by :func:`cycle_weights`;
    a source that the table lacks gets weight 0 and is not taken.

    Returns all columns of ``docs`` and, added or replaced: ``size``, ``source_size``
    (long), ``target`` (double), ``times`` (int), ``taken`` (long, size x times). Texts are
    never shuffled: a first pass writes their sizes and keys, from which sums and cuts per
    source are made, a second one applies those. See :func:`budget_cut` for large sources.

    Defined cases: a null source is a source of its own, last in order; a null or empty
    text has size 0, is taken 0 words; a long text is one document, taken whole or not;
    rows that agree in id and text tie, and if the budget ends among them, as many are taken
    as it pays for; an empty table gives an empty table; columns that begin with two
    underscores are not for callers.
    """
    rows = docs.drop("source_size", "target", "times", "taken").withColumn("__words", blank_words(F.col(text_col))).withColumn("size", F.size("__words").cast("long"))
    u = unit_hash(F.lit(seed), F.col(id_col), F.md5(F.col(text_col)))
    # ln of the exponential key: the same order, on a scale that spreads evenly.
    rows = rows.withColumn("__key", F.log(-F.log(u)) - F.log(quality_weight(F.col("__words"), F.col(text_col)) if quality is None else quality)).drop("__words")
    rows = rows.withColumn("__tie", F.struct(F.col(id_col).cast("string").alias("id"), F.md5(F.col(text_col)).alias("h")))
    narrow = materialise(rows.select(F.col(source_col).alias("__s"), "size", "__key", "__tie"))
    sizes = materialise(narrow.groupBy("__s").agg(F.sum("size").alias("source_size")))
    if not isinstance(weights, DataFrame):
        weights = cycle_weights(sizes, "__s", weights)
    weights = weights.select(F.col(weights.columns[0]).alias("__s2"), F.col("weight").cast("double").alias("weight"))
    plan = sizes.join(weights, F.col("__s").eqNullSafe(F.col("__s2"))).select("__s", "source_size", "weight")
    plan = materialise(source_targets(plan, share, max_epochs))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0))
    plan = plan.withColumn("__epochs", epochs).withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
    cut = budget_cut(narrow, "__s", "__key", "__tie", "size", plan, "__rest")
    plan = plan.join(cut, F.col("__s").eqNullSafe(F.col("__g")), "left").drop("__g")
    plan = materialise(plan.select("__s", "source_size", "target", "__epochs", "__rest", "__edge", "__cut", "__copies", "__fit"))
    out = rows.join(small(plan), F.col(source_col).eqNullSafe(F.col("__s")), "left")
    more = (F.col("__rest") > 0) & within(F.col("__key"), F.col("__tie"))
    out = out.withColumn("__more", F.coalesce(more.cast("int"), F.lit(0)))
    if plan.filter("__rest > 0 and __fit < __copies").limit(1).count():
        cut_key = F.struct(F.col("__key").alias("key"), F.col("__tie").alias("tie"))
        parted = F.coalesce((F.col("__rest") > 0) & (F.col("__fit") < F.col("__copies")) & (cut_key == F.col("__cut")), F.lit(False))
        out = out.filter(~parted).unionByName(_first_of_equals(out.filter(parted)))
    out = out.withColumn("times", (F.coalesce("__epochs", F.lit(0)) + F.col("__more")).cast("int"))
    out = out.withColumns({"source_size": F.coalesce("source_size", F.lit(0)).cast("long"), "target": F.coalesce("target", F.lit(0.0)), "taken": F.col("size") * F.col("times")})
    return out.drop("__s", "__epochs", "__rest", "__edge", "__cut", "__copies", "__fit", "__key", "__tie", "__more")


def _first_of_equals(equals: DataFrame) -> DataFrame:
    """Rows that tie at the cut of their source (``__s``), with ``__more`` 1 for the first ``__fit`` of each source.

    Rows are written, so that each has a place: its file and its number there. Files are
    summed in order, and places are sorted in the one file of a source where ``__fit`` is
    reached; a hot group of equals is never gathered."""
    kept = materialise(equals)
    rows = kept.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    upto = Window.partitionBy("__s").orderBy("__file").rowsBetween(Window.unboundedPreceding, 0)
    files = rows.groupBy("__s", "__fit", "__file").agg(F.count(F.lit(1)).alias("__n")).withColumn("__end", F.sum("__n").over(upto))
    edge = files.filter(F.col("__end") >= F.col("__fit")).groupBy("__s", "__fit").agg(F.min_by(F.struct("__file", (F.col("__fit") - F.col("__end") + F.col("__n")).alias("__k")), "__end").alias("__e"))
    edge = materialise(edge.select(F.col("__s").alias("__s2"), F.col("__e.__file").alias("__last"), F.col("__e.__k").alias("__k")))
    there = rows.join(small(edge), F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__file") == F.col("__last")))
    place = there.groupBy("__s2", "__last", "__k").agg(F.sort_array(F.collect_list("__at")).alias("__places")).select("__s2", "__last", F.get("__places", F.col("__k").cast("int") - 1).alias("__to"))
    out = rows.join(small(materialise(place)), F.col("__s").eqNullSafe(F.col("__s2")), "left")
    first = (F.col("__file") < F.col("__last")) | ((F.col("__file") == F.col("__last")) & (F.col("__at") <= F.col("__to")))
    return out.withColumn("__more", F.coalesce(first.cast("int"), F.lit(0))).select(*equals.columns)
