"""Near copies by SimHash fingerprints, completed by exact shingle similarity: nothing sampled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise
from hourgrid.llm.common import blank_words, lower_word, row_key, small
from hourgrid.llm.components import components
from hourgrid.llm.simhash import link_prints, prints_of, shingle_hashes

#: A text that many pairs name is dealt to so many tasks when its pairs are confirmed.
SALTS = 8
#: Prefixes are longer than the bound asks by one shingle in so many, and more than one must be shared.
MORE = 16
#: Members of a large group that one task compares with the whole group.
BLOCK = 1000
#: Words of 64 bits in the bitmap of a shingle set.
BITMAP = 8


def _least(n: Column, similarity: float) -> Column:
    """Shingles that a text of ``n`` shares at least with one of that similarity."""
    return F.ceil(n * F.lit(similarity) - F.lit(1e-9)).cast("int")


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``similarity``."""
    left = sets.join(pairs.select(F.col("a").alias("__k")).distinct(), "__k", "left_semi")
    left = left.select(F.col("__k").alias("a"), F.col("__n").alias("__na"), F.col("__s").alias("__sa"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    right = sets.select(F.col("__k").alias("b"), F.col("__n").alias("__nb"), F.col("__s").alias("__sb"))
    both = pairs.withColumn("__salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(left, ["a", "__salt"]).join(right, "b")
    shared = F.size(F.array_intersect("__sa", "__sb"))
    return both.filter(shared + F.lit(1e-9) >= F.lit(similarity) * (F.col("__na") + F.col("__nb") - shared)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def with_companions(texts: DataFrame, similarity: float) -> DataFrame:
    """``__k`` of the texts (``__k``, ``__n``, ``__p``: prefixes of :func:`prefix`) that may be similar to another."""
    tokens = texts.select("__k", "__n", F.explode("__p").alias("__t"))
    shared = tokens.groupBy("__t").agg(F.count(F.lit(1)).alias("__df")).filter("__df > 1").select("__t")
    held = tokens.join(small(materialise(shared)), "__t", "left_semi").groupBy("__k", "__n").agg(F.count(F.lit(1)).alias("__m"))
    return materialise(held.filter(F.col("__m") >= F.ceil(F.col("__n") * F.lit(similarity / MORE) - F.lit(1e-9))).select("__k"))


def prefix(shingles: Column, similarity: float) -> Column:
    """The least of a text's hashes: as many as a similar text may lack, and 1 in ``MORE`` of all.
    Of these, similar texts share the lesser of their 1 in ``MORE`` at least."""
    n = F.size(shingles)
    return F.slice(F.sort_array(shingles), 1, n - _least(n, similarity) + F.ceil(n / MORE).cast("int"))


def bitmap(hashes: str) -> Column:
    """``BITMAP`` longs: a bit is 1 if an odd number of the hashes fall to it. The bitmaps of two
    sets differ in at most as many bits as the sets in members."""
    own = f"filter({hashes}, h -> (shiftrightunsigned(h, 6) & {BITMAP - 1}) = j)"
    return F.expr(f"transform(sequence(0, {BITMAP - 1}), j -> aggregate({own}, 0L, (a, h) -> a ^ shiftleft(1L, cast(h & 63 as int))))")


def _possible(similarity: float) -> Column:
    """Whether two texts of a group can share enough: by their numbers of shingles that occur
    elsewhere, by what follows the group's shingle, and by the bits in which bitmaps differ."""
    need = F.lit(similarity / (1 + similarity)) * (F.col("__n") + F.col("__n2")) - F.lit(1e-9)
    differ = sum((F.bit_count(F.col("__bits")[j].bitwiseXOR(F.col("__bits2")[j])) for j in range(BITMAP)), F.lit(0))
    rest = F.least(F.col("__c") - F.col("__at"), F.col("__c2") - F.col("__at2"))
    return (rest >= need) & ((F.col("__c") + F.col("__c2") - differ) / 2 >= need)


def _open_pairs(named: DataFrame, similarity: float) -> DataFrame:
    """Pairs (``__k`` < ``b``) of members of one group that lie in different components (``__r``) and can be similar.

    Shingles that just the same texts hold make the same pairs, so of such groups the one of the first shingle is
    taken: shingles of one passage that many texts share are one group. Only texts of near enough numbers of
    shingles meet, and large groups are dealt to blocks of :data:`BLOCK` members, each of which meets the whole
    group in a task of its own."""
    same = [F.bit_xor(F.xxhash64("__k", F.lit(i))) for i in range(2)]
    groups = named.groupBy("__t").agg(F.min("__r").alias("__lo"), F.max("__r").alias("__hi"), F.count(F.lit(1)).alias("__m"), same[0].alias("__x"), same[1].alias("__y"), F.sum(F.col("__at").cast("long")).alias("__p"))
    # Members hold the shingles in one order, so the least sum of places is that of the first.
    open_ = groups.filter("__lo < __hi").groupBy("__m", "__x", "__y").agg(F.min_by("__t", "__p").alias("__t")).select("__t", "__m")
    named = materialise(named.join(small(materialise(open_)), "__t"))
    # Similar texts have numbers of shingles within a factor of 1 / similarity: the same band or the next one.
    band = F.floor(F.log(F.col("__n")) / F.lit(-math.log(similarity))).cast("int")
    blocks = F.ceil(F.col("__m") / BLOCK).cast("int")
    left = named.withColumns({"__band": band, "__block": F.pmod(F.xxhash64("__k"), blocks).cast("int")})
    right = named.withColumn("__band", F.explode(F.array(*[band + i for i in (-1, 0, 1)]))).withColumn("__block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = right.select("__t", "__band", "__block", F.col("__k").alias("b"), F.col("__r").alias("__r2"), F.col("__n").alias("__n2"), F.col("__c").alias("__c2"), F.col("__at").alias("__at2"), F.col("__bits").alias("__bits2"))
    return left.join(right, ["__t", "__band", "__block"]).filter((F.col("__k") < F.col("b")) & (F.col("__r") != F.col("__r2")) & _possible(similarity))


def link_texts(some: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Links (a < b) between texts whose shingle sets have a Jaccard similarity of at least
    ``similarity``; the components of the links are those of all such pairs.

    ``some`` has ``__k`` (long, distinct), ``__n`` (number of distinct shingles) and ``__s``
    (their hashes). A text whose shingles do not occur in others often enough is out; the
    prefixes of the rest are taken in order of frequency, rare shingles first.

    In each group of a prefix shingle, all are compared with the member whose shingles are
    the most common, usually what the others were copied from. Only pairs that this leaves in
    different components, and whose bitmaps differ in few enough bits, are compared after
    it, so a large group of copies costs about one comparison a member.
    """
    every = some.select("__k", "__n", F.explode("__s").alias("__t"))
    often = every.groupBy("__t").agg(F.count(F.lit(1)).alias("__df")).filter("__df > 1")
    ordered = every.join(often, "__t").groupBy("__k", "__n").agg(F.sort_array(F.collect_list(F.struct("__df", "__t"))).alias("__l"), F.avg(F.log("__df")).alias("__w"))
    sets = ordered.select("__k", "__n", F.size("__l").alias("__c"), (F.col("__w") * F.size("__l") / F.col("__n")).alias("__w"), F.col("__l.__t").alias("__s"))
    # Bitmaps are made once a text; behind the explode below they would be made once a row.
    sets = materialise(sets.filter(F.col("__c") >= _least(F.col("__n"), similarity)).withColumn("__bits", bitmap("__s")))
    rare = F.slice("__s", 1, F.col("__c") - _least(F.col("__n"), similarity) + 1)
    groups = materialise(sets.select("__k", "__n", "__c", "__w", "__bits", F.posexplode(rare).alias("__at", "__t")))
    # Round one: everyone against the most common member of the group.
    heads = groups.groupBy("__t").agg(F.max(F.struct("__w", "__k", "__n", "__c", "__at", "__bits")).alias("__h"), F.count(F.lit(1)).alias("__m")).filter("__m > 1")
    heads = small(materialise(heads.select("__t", F.col("__h.__k").alias("a"), F.col("__h.__n").alias("__n2"), F.col("__h.__c").alias("__c2"), F.col("__h.__at").alias("__at2"), F.col("__h.__bits").alias("__bits2"))))
    possible = _possible(similarity)
    near = groups.join(heads, "__t").filter((F.col("a") != F.col("__k")) & possible).select("a", F.col("__k").alias("b")).distinct()
    links = materialise(_confirm(materialise(near), sets, similarity))
    # Round two: what round one left in different components of one group.
    roots = components(links).select(F.col("node").alias("__k"), F.col("root").alias("__r"))
    named = groups.join(roots, "__k", "left").withColumn("__r", F.coalesce("__r", "__k"))
    met = _open_pairs(named, similarity)
    rest = materialise(met.select(F.col("__k").alias("a"), "b").distinct())
    return links.union(_confirm(rest, sets, similarity))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 2) -> DataFrame:
    """``docs`` with one document of each component of near copies: that of the least id (null
    last; of equal ids the one of least key).

    Two texts are linked if their SimHash fingerprints over ``shingle``-word shingles (A-Z
    lowered, words between white space) differ in at most ``budget`` bits, found by the trie
    self-join, or if their sets of those shingles have a Jaccard similarity of at least
    ``similarity``. Most pairs of that similarity differ in 3 to 13 bits of 64, more than
    fingerprints can be joined by, so an exact prefix-filtered join finds the others.

    Texts of the same words are one text, named by a 64-bit hash, before any join. Only
    texts that the prefix filter leaves are read again with all their shingles.

    Defined cases: null, empty and blank texts are one text; a text of fewer than
    ``shingle`` words is one shingle; very long texts are taken whole; repeated rows are one
    document; an empty table gives an empty table; other columns are kept as they are.
    """
    words = F.transform(blank_words(F.col(text_col)), lower_word)
    rows = docs.select(F.col(id_col).alias("__id"), row_key(F.col(id_col), F.col(text_col)).alias("__rk"), words.alias("__words"))
    rows = rows.select("__id", "__rk", F.xxhash64(F.array_join("__words", " ")).alias("__k"), shingle_hashes("__words", shingle).alias("__h"))
    rows = rows.select("*", F.array_distinct("__h").alias("__s")).select("__id", "__rk", "__k", F.size("__s").alias("__n"), prefix(F.col("__s"), similarity).alias("__p"), "__h")
    rows = materialise(prints_of(rows))
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__rk").alias("key"))
    firsts = materialise(rows.groupBy("__k").agg(F.min(order).alias("__o"), F.first("__print").alias("__print")))
    # Links of fingerprints, between the least text of each.
    prints = materialise(firsts.groupBy("__print").agg(F.min("__k").alias("__first")))
    near = link_prints(prints.select("__print"), budget)
    ends = [prints.select(F.col("__print").alias(c), F.col("__first").alias(f"__{c}")) for c in ("a", "b")]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))
    same = firsts.join(prints, "__print").select(F.col("__first").alias("a"), F.col("__k").alias("b")).filter("a < b")
    # Links of similarity.
    named = firsts.select("__k", F.col("__o.key").alias("__rk"))
    # Repeated rows come several times here, which only leaves more of them in.
    once = rows.join(small(named.select("__rk")), "__rk", "left_semi").filter("__n > 0").select("__k", "__n", "__p")
    some = materialise(named.join(with_companions(once, similarity), "__k"))
    read = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("__rk"), F.col(text_col).alias("__text")).join(small(some), "__rk")
    read = read.select("__k", F.transform(blank_words(F.col("__text")), lower_word).alias("__words")).select("__k", F.array_distinct(shingle_hashes("__words", shingle)).alias("__s"))
    texts = materialise(read.dropDuplicates(["__k"]).select("__k", F.size("__s").alias("__n"), "__s"))
    roots = components(link_texts(texts, similarity).union(near).union(same))
    of = firsts.join(roots, F.col("__k") == F.col("node"), "left").withColumn("__r", F.coalesce("root", "__k"))
    keep = of.groupBy("__r").agg(F.min("__o").alias("__o")).select(F.col("__o.key").alias("__rk"))
    return docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col))).join(keep, "__rk", "left_semi").dropDuplicates(["__rk"]).drop("__rk")
