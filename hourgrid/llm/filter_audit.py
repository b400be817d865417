"""How filters interact: what each removes in every order, from counts per set of failures."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import UPPER, blank_words

#: Filters of an audit at most: 2^k counts per part, and k! orders.
MOST_FILTERS = 6


def text_failures(text: Column, least_words: int = 200, least_distinct: int = 50, most_upper: int = 2, signs: str = "#$%&*|") -> dict[str, Column]:
    """Failure conditions by filter letter: A, under ``least_words`` words; B, distinct words under
    ``least_distinct`` in 100; C, A-Z over ``most_upper`` in 100 code points; D, any of ``signs``.
    Words are maximal runs without blanks; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = blank_words(text)
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < least_words,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * least_distinct,
        "C": upper * 100 > F.char_length(text) * most_upper,
        "D": text.rlike("[" + "".join(rf"\x{ord(c):02x}" for c in signs) + "]"),
    }


def failure_counts(docs: DataFrame, failures: dict[str, Column], labels: DataFrame, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail just the filters whose bits are
    set (bit i: the i-th filter, ``copies`` last), and those of them with quality 1 and toxic 1.

    ``copies`` names the filter that a text fails if a row of smaller id has the same text,
    table-wide. It needs each text's least id only. Rows are folded by id and text (repeats),
    joined to their labels, folded by text, part, mask and labels, and what is left of one text, a
    row per part and kind of label at most, is compared with the text's least id. Every fold
    combines before its shuffle, so a text of a third of all rows is no large group. Texts
    travel as 128-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(F.coalesce(bad, F.lit(False)), F.lit(1 << i)).otherwise(0) for i, bad in enumerate(failures.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.md5(text)).alias("__h"))
    rows = rows.groupBy("__id", "part", "mask", "__h").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.groupBy(F.col(id_col).alias("__id2")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(flags, F.col("__id") == F.col("__id2"), "left").fillna(0, ["good", "toxic"])
    if copies is not None:
        # How many rows have the least id comes along with it; rows without id are never copies.
        unknown = F.sum(F.when(F.col("__id").isNull(), F.col("n")).otherwise(0))
        kinds = rows.groupBy("__h", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("__id").alias("__least"), F.min_by("n", "__id").alias("__n"), unknown.alias("__unknown"))
        first = F.min("__least").over(Window.partitionBy("__h"))
        kinds = kinds.withColumn("__first", F.when(F.col("__least") == first, F.col("__n")).otherwise(0) + F.col("__unknown"))
        bit = 1 << len(failures)
        both = F.array(F.struct(F.col("mask").alias("mask"), F.col("__first").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("__first")).alias("n")))
        rows = kinds.select("part", "good", "toxic", F.explode(both).alias("__m")).select("part", "good", "toxic", "__m.mask", "__m.n")
    return rows.groupBy("part", "mask").agg(*[F.sum(v).cast("long").alias(c) for c, v in (("n", F.col("n")), ("good", F.col("n") * F.col("good")), ("toxic", F.col("n") * F.col("toxic")))])


def subset_survivors(counts: DataFrame, k: int, values: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """One row per part: for each value an array ``s_<value>`` over all subsets of the ``k`` filters, how many
    documents pass every filter of the subset, and ``only``, how many fail just one, by filter.

    A document survives a subset if its mask lies within the complement. The sums over all
    masks within a set are the zeta transform of the counts: k passes over the array, one per
    bit, each adding to the sets that hold the bit their like without it."""
    full = (1 << k) - 1
    cells = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(v))), F.lit(0)).alias(f"__{v}{m}") for v in values for m in range(full + 1)]
    parts = counts.groupBy("part").agg(*cells)
    for v in values:
        parts = parts.withColumn(f"s_{v}", F.array(*[F.col(f"__{v}{m}") for m in range(full + 1)]))
    only = F.array(*[F.col(f"__{values[0]}{1 << i}") for i in range(k)]).alias("only")
    parts = parts.select("part", only, *[f"s_{v}" for v in values])
    for i in range(k):
        # get() is null beyond the array; the place without the bit is always in it.
        step = lambda v: F.transform(F.col(f"s_{v}"), lambda x, m: x + F.when(m.bitwiseAND(1 << i) != 0, F.get(F.col(f"s_{v}"), m.bitwiseAND(full ^ (1 << i)))).otherwise(0))  # noqa: B023, E731
        parts = parts.withColumns({f"s_{v}": step(v) for v in values})
    # Sums within a set, to survivors of its complement.
    return parts.withColumns({f"s_{v}": F.reverse(F.col(f"s_{v}")) for v in values})


def audit_orders(survivors: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for
    every part, order of the ``filters`` (one letter each) and step.

    What a step removes is the difference between two neighbouring subsets, and so for labels.
    ``shapley`` sums a filter's removals over all orders: each subset without it counts as often as
    orders put just that subset before it."""
    k = len(filters)
    orders = F.lit(["".join(p) for p in permutations(filters)])
    n = lambda m: F.get(F.col("s_n"), F.lit(m))
    share = []
    for i in range(k):
        total = F.lit(0).cast("long")
        for m in (m for m in range(1 << k) if not m >> i & 1):
            size = m.bit_count()
            total = total + (n(m) - n(m | 1 << i)) * F.lit(factorial(size) * factorial(k - 1 - size))
        share.append(total)
    rows = survivors.withColumn("__shapley", F.array(*share)).withColumn("filter_order", F.explode(orders))
    rows = rows.withColumn("step", F.explode(F.lit(list(range(1, k + 1)))))
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    at = F.instr(F.lit(filters), letter) - 1
    bit = lambda c: F.pow(F.lit(2), F.instr(F.lit(filters), c) - 1).cast("int")
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, j: acc + F.when(j < F.col("step"), bit(F.substr("filter_order", j, F.lit(1)))).otherwise(0))
    rows = rows.withColumns({"__at": at, "__before": before, "__bit": bit(letter)})
    was, now = (lambda v: F.get(f"s_{v}", F.col("__before"))), (lambda v: F.get(f"s_{v}", F.col("__before") + F.col("__bit")))
    gone = was("n") - now("n")
    failing = F.get("s_n", F.lit(0)) - F.get("s_n", F.col("__bit"))
    return rows.select(
        "part", "filter_order", "step", now("n").alias("kept"), gone.alias("removed"), (failing - gone).alias("redundant"), F.get("only", F.col("__at")).alias("unique_fails"),
        (was("good") - now("good")).alias("good_lost"), (was("toxic") - now("toxic")).alias("toxic_lost"), F.get("__shapley", F.col("__at")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each of some filters removes, per part (``part_col``), order and step; see :func:`audit_orders`.

    ``failures`` maps a letter to a condition on the columns of ``docs`` (default
    :func:`text_failures`); ``copies`` names one more filter, for copies of texts of smaller ids,
    or is None. Documents are read once; counts per mask are all that the transform sees.

    Defined cases: a null text is empty, a null condition no failure; a null part is the part
    ''; repeated rows count each, and are no copies of themselves; a row without id is no copy and
    has none; a label of several rows is 1 if any is; ids without labels have neither; very
    long texts count as a whole; an empty table gives an empty table; other columns are not
    read, whatever their names.
    """
    failures = text_failures(F.col(text_col)) if failures is None else failures
    filters = "".join([*failures, *([] if copies is None else [copies])])
    if not failures or len(set(filters)) != len(failures) + (copies is not None) or len(filters) > MOST_FILTERS:
        raise ValueError(f"filters are named by distinct letters, {MOST_FILTERS} at most: {filters}")
    counts = failure_counts(docs, failures, labels, copies, id_col, text_col, part_col)
    return audit_orders(subset_survivors(counts, len(filters)), filters)
