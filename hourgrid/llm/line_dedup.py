"""Line dedup: drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise
from hourgrid.llm.common import ascii_lower, row_key, small

def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop from every document the lines that at least ``min_docs`` documents hold.

    Lines are split at ``\\n`` and compared without white space at their ends and
    without ASCII case. A line of fewer than ``min_chars`` code points is never dropped.
    Returns all columns of ``docs`` with ``text_col`` reassembled by position from the
    lines that stay, and ``n_lines`` and ``n_dropped`` (long) added or replaced.

    Lines travel as 128-bit hashes; texts are shuffled once, by row. A document's repeats
    of a line are folded before the shuffle, counts combine on the map side, and the
    join that flags lines is an equi-join that adaptive execution splits at hot lines.

    Defined cases: a null or empty text is one empty line and yields ''; rows of one
    ``id_col`` are one document when documents are counted (null is one id); repeated
    rows stay, each with the same result; an empty table gives an empty table; a text
    whose lines all go becomes ''; very long texts are taken whole, a row in one task;
    other columns are kept as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col)))
    # One hash per line, null for lines too short to be dropped; read twice, so written once.
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    hashes = F.transform("__keys", lambda x: F.when(F.char_length(x) >= min_chars, F.md5(x)))
    hashed = materialise(rows.select("__rk", F.col(id_col).alias("__id"), keys.alias("__keys")).select("__rk", "__id", hashes.alias("__h")))
    # Distinct strings are found by hashing, distinct binaries are not; so binaries come last.
    pairs = hashed.select("__id", F.explode(F.array_distinct("__h")).alias("__k")).filter("__k is not null").select("__id", F.unhex("__k").alias("__k")).distinct()
    shared = materialise(pairs.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_docs).select("__k"))
    hits = hashed.select("__rk", F.posexplode("__h").alias("__pos", "__k")).filter("__k is not null").withColumn("__k", F.unhex("__k")).join(small(shared), "__k", "left_semi")
    # Positions as a set: repeated rows give the same positions.
    drops = hits.groupBy("__rk").agg(F.array_sort(F.collect_set("__pos")).alias("__drop"))
    joined = rows.join(drops, "__rk", "left").withColumn("__lines", F.split(text, "\n", -1))
    # The runs of lines between dropped positions, by position.
    edges = F.concat(F.array(F.lit(-1)), F.col("__drop"))
    ends = F.concat(F.col("__drop"), F.array(F.size("__lines")))
    runs = F.flatten(F.zip_with(edges, ends, lambda a, b: F.slice(F.col("__lines"), a + 2, b - a - 1)))
    kept = F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(runs, "\n"))
    n = F.size("__lines").cast("long")
    dropped = F.coalesce(F.size("__drop"), F.lit(0)).cast("long")
    return joined.withColumns({"n_lines": n, "n_dropped": F.when(F.col("__drop").isNull(), F.lit(0).cast("long")).otherwise(dropped), "__kept": kept}).withColumn(text_col, F.col("__kept")).drop("__rk", "__drop", "__lines", "__kept")
