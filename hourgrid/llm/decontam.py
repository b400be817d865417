"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise
from hourgrid.llm.common import lower_word, only, row_key, small

#: Characters between words: all of ASCII but digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")
    return F.transform(words, lower_word)


def _grams(words: str, k: int) -> Column:
    """The hash of every k words in a row; empty if there are fewer."""
    n = F.size(words)
    at = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    return F.when(n >= k, F.transform(at, lambda i: F.xxhash64(F.slice(F.col(words), i, k)))).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(df: DataFrame, words: str, k: int, span: int) -> DataFrame:
    """Rows of ``df`` exploded to their winnowed fingerprints (``__pos``, ``__fp``).

    A window of ``span`` words holds w = span - k + 1 k-grams; its fingerprint is the least of
    their hashes. Windows in a row with one fingerprint give one row, at the first of
    them, and another after every w windows. So two texts that share ``span`` words share
    a fingerprint, and it stands for windows ``__pos`` to ``__pos`` + w - 1."""
    w = span - k + 1
    cols = [c for c in df.columns if c != words]
    df = df.select(*cols, _grams(words, k).alias("__g"))
    n = F.size("__g")
    least = F.transform(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: F.array_min(F.slice(F.col("__g"), i, w)))
    df = df.select(*cols, F.when(n >= w, least).otherwise(F.array().cast("array<bigint>")).alias("__m"))
    kept = F.transform("__m", lambda x, i: F.when((i % w == 0) | (x != F.get(F.col("__m"), i - 1)), x))
    return df.select(*cols, F.posexplode(kept).alias("__pos", "__fp")).filter("__fp is not null")


def find_overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """Where documents repeat ``span`` consecutive words of a benchmark item.

    Winnowed fingerprints of both sides meet in an equi-join on hashes; hits are extended
    to the windows of ``span`` words around them, and those are compared as words. An item
    of fewer words than ``span`` (but not none) is one window, for which every gram of its
    length is a fingerprint; only lengths that occur cost a pass. Either way the result
    equals comparing all windows.

    Returns all columns of ``docs`` and, added or replaced: ``n_words``, ``n_hit`` (words
    inside an occurrence), ``n_items`` (long), ``items`` (item ids as strings, sorted),
    ``windows`` (start and end, in words, of each hit window) and ``contaminated``.

    Hashes and positions are shuffled, not pairs of texts: hits are folded per document,
    so a passage in many documents costs each of them one row. The benchmark's side is
    broadcast if it is counted to be small, else joined by a shuffle; so are the keys of the
    documents with hits, and then only the texts of these are shuffled.

    Defined cases: null and empty texts have no words and no hits; repeated rows each get
    the result; an empty benchmark hits nothing; an empty table of documents gives an empty
    table; very long texts are taken whole; a null item id reads ''.
    """
    rows = docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col))).withColumn("__words", words_of(F.col(text_col)))
    words = rows.select("__rk", "__words")
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("__item"), words_of(F.col(item_text_col)).alias("__words")).filter(F.size("__words") > 0)
    items = materialise(items.withColumn("__len", F.least(F.size("__words"), F.lit(span))))
    windows = items.select("__item", "__len", F.explode(F.transform(F.sequence(F.lit(1), F.size("__words") - F.col("__len") + 1), lambda i: F.array_join(F.slice("__words", i, F.col("__len")), " "))).alias("__text"))
    windows = materialise(windows.groupBy("__len", "__text").agg(F.array_sort(F.collect_set("__item")).alias("__items")))

    keys = _fingerprints(items.filter(F.col("__len") == span).select("__words"), "__words", k, span).select("__fp").distinct()
    hits = _fingerprints(words, "__words", k, span).join(small(keys), "__fp", "left_semi")
    # Of the windows that a fingerprint stands for, the first and how many follow.
    starts = [hits.select("__rk", F.lit(span).alias("__len"), F.col("__pos").alias("__at"), F.lit(span - k).alias("__more"))]
    for (n,) in items.filter(F.col("__len") < span).select("__len").distinct().collect():  # less than span numbers
        own = items.filter(F.col("__len") == n).select(F.element_at(_grams("__words", n), 1).alias("__fp")).distinct()
        grams = words.select("__rk", F.posexplode(_grams("__words", n)).alias("__pos", "__fp")).join(small(own), "__fp", "left_semi")
        starts.append(grams.select("__rk", F.lit(n).alias("__len"), F.col("__pos").alias("__at"), F.lit(0).alias("__more")))
    found = starts[0]
    for more in starts[1:]:
        found = found.unionByName(more)
    found = materialise(found.groupBy("__rk").agg(F.collect_set(F.struct("__len", "__at", "__more")).alias("__found")))

    # Extend: the words around the hits are looked up again, in documents that have any.
    near = only(rows.select("__rk", F.col(text_col).alias("__t")), found.select("__rk")).join(found, "__rk").select("__rk", "__found", words_of(F.col("__t")).alias("__words"))
    # A window as one number, start x 2^16 + length: distinct numbers are found by hashing.
    reach = F.flatten(F.transform("__found", lambda f: F.transform(F.sequence(f["__at"], f["__at"] + f["__more"]), lambda s: s.cast("long") * (1 << 16) + f["__len"])))
    near = near.select("__rk", "__words", F.transform(F.array_distinct(reach), lambda r: F.struct((r % (1 << 16)).cast("int").alias("len"), F.floor(r / (1 << 16)).cast("int").alias("start"))).alias("__reach"))
    fits = F.filter("__reach", lambda r: r["start"] + r["len"] <= F.size("__words"))
    texts = F.transform(fits, lambda r: F.struct(r["len"].alias("len"), r["start"].alias("start"), F.array_join(F.slice("__words", r["start"] + 1, r["len"]), " ").alias("text")))
    near = near.select("__rk", F.explode(texts).alias("__r")).select("__rk", F.col("__r.len").alias("__len"), F.col("__r.start").alias("__start"), F.col("__r.text").alias("__text"))
    hit = near.join(small(windows), ["__len", "__text"]).groupBy("__rk").agg(
        F.array_sort(F.collect_set(F.struct(F.col("__start").alias("start"), (F.col("__start") + F.col("__len")).alias("end")))).alias("__at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("__items"),
    )

    total = F.aggregate("__at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n")))
    out = rows.withColumn("n_words", F.size("__words").cast("long")).drop("__words").join(hit.withColumn("__hit", total["n"]), "__rk", "left")
    return out.withColumns({
        "n_hit": F.coalesce("__hit", F.lit(0)).cast("long"), "n_items": F.coalesce(F.size("__items"), F.lit(0)).cast("long"),
        "items": F.coalesce("__items", F.array().cast("array<string>")), "windows": F.coalesce("__at", F.array().cast("array<struct<start:int,end:int>>")),
        "contaminated": F.col("__hit").isNotNull(),
    }).drop("__rk", "__at", "__items", "__hit")
