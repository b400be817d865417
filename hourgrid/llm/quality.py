"""Quality selection by importance resampling over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise
from hourgrid.llm.common import budget_cut, crc_fold, row_key, unit_hash, within
from hourgrid.llm.labelled import MAX_LABELLED, labelled_sample

#: n-grams are hashed to this many buckets.
BUCKETS = 10_000
#: A token: letters and digits, or a run of other signs.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def token_hashes(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))


def ngram_buckets(values: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, list) of every token and every pair of neighbouring tokens of a list."""
    a = values[offsets[0] : offsets[-1]].astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair = owner[1:] == owner[:-1]
    two = ((a[:-1] * 1_000_003 + a[1:]) % buckets)[pair]
    return np.r_[a % buckets, two], np.r_[owner, owner[1:][pair]]


@dataclass
class QualityModel:
    """``ratio``: log p(target) - log p(raw) per bucket."""

    ratio: np.ndarray

    def log_ratio(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log p(text | target) - log p(text | raw): the sum over the text's n-grams."""
        bucket, owner = ngram_buckets(values, offsets, len(self.ratio))
        return np.bincount(owner, self.ratio[bucket], len(offsets) - 1).astype(np.float64)


def _slices(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with values and offsets of their last column, a list."""
    for b in batches:
        for lo in range(0, b.num_rows, size):
            part = b.slice(lo, size)
            lists = part.column(part.num_columns - 1)
            yield part, lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for part, values, offsets in _slices(batches):
            bucket, owner = ngram_buckets(values, offsets, buckets)
            target = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
            counts[0] += np.bincount(bucket, minlength=buckets)
            counts[1] += np.bincount(bucket[target[owner]], minlength=buckets)
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[0][seen]), pa.array(counts[1][seen])], ["b", "raw", "target"])

    return run


def _ratios(model: QualityModel, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in _slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.log_ratio(values, offsets))], names)

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Two hashed n-gram models, each count of a bucket plus one: raw from all of ``docs``, target
    from the documents with label 1 among at most ``max_labelled`` labelled rows that are
    not held out. Labels say which texts the target is, nothing else is fitted to them.

    Counts are summed in each task and come to the driver as ``buckets`` rows. Defined cases:
    null ids and labels are no labels; null and empty texts have no n-grams, long ones are
    counted whole; a repeated row counts each time; without good labels, and on empty
    tables, all ratios follow from the raw counts alone; other columns are not read.
    """
    sample = F.broadcast(materialise(labelled_sample(labels, label_col, id_col, max_labelled)))  # at most max_labelled rows
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    marked = rows.join(sample, "__id", "left").select(F.coalesce(F.col("__y") == 1, F.lit(False)).alias("t"), token_hashes(F.col("__t")).alias("__h"))
    counts = marked.mapInArrow(_count(buckets), "b int, raw long, target long").groupBy("b").agg(F.sum("raw"), F.sum("target")).collect()  # at most `buckets` rows
    table = np.zeros((buckets, 2))
    for b, raw, target in counts:
        table[b] = raw, target
    p = (table + 1) / (table + 1).sum(axis=0)
    return QualityModel(np.log(p[:, 1]) - np.log(p[:, 0]))


def resample(docs: DataFrame, model: QualityModel, k: int | None = None, temperature: float = 1.0, cap: float = 0.0, id_col: str = "doc_id", text_col: str = "text", seed: str = "quality") -> DataFrame:
    """All columns of ``docs`` and, added or replaced: ``log_weight`` (double), ``noisy_weight``
    (log_weight plus a Gumbel variate of a seeded hash of the row) and ``selected``: whether
    the row is among the ``k`` of largest ``noisy_weight``, a sample of ``k`` without
    replacement in proportion to exp(log_weight).

    ``log_weight`` is log p(text | target) - log p(text | raw), divided by ``temperature`` and
    truncated at ``cap``. Importance weights of texts grow exponentially with their length;
    without truncation the longest texts of the target's kind would crowd out all others, so
    a text that the target explains at least as well as the raw corpus has weight 1 by default.
    A larger temperature lets more of the less likely texts in.

    Without ``k``, as many rows are taken as rejection sampling by the same weights would
    accept: the sum of min(1, exp(log_weight)). The k-th weight is found from counts per
    narrow bin and the rows of one bin; rows are never sorted as a whole, texts are
    shuffled once, by row.

    Defined cases: null and empty texts have log-ratio 0; very long ones are weighed whole;
    repeated rows get equal weights, and at the boundary both or neither are selected; an
    empty table gives an empty table; columns that begin with two underscores are not for
    callers, other names may clash.
    """
    rows = docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col)))
    u = unit_hash(F.lit(seed), F.col("__rk"))
    sums = rows.select("__rk", u.alias("__u"), token_hashes(F.col(text_col)).alias("__h")).mapInArrow(_ratios(model, ["__rk", "__u", "__m"]), "__rk string, __u double, __m double")
    weight = F.least(F.col("__m") / float(temperature), F.lit(float(cap)))
    sums = sums.select("__rk", weight.alias("log_weight"), (weight - F.log(-F.log("__u"))).alias("noisy_weight"), F.lit(0).alias("__s"), F.lit(1).alias("__one"))
    # A log-scale in both directions, largest weight first.
    key = -F.signum("noisy_weight") * F.log1p(F.abs("noisy_weight"))
    sums = materialise(sums.withColumn("__key", key))
    if k is None:  # decimals add up alike in any order
        k = int(sums.agg(F.coalesce(F.sum(F.exp(F.least("log_weight", F.lit(0.0))).cast("decimal(18,12)")), F.lit(0))).first()[0])
    budget = docs.sparkSession.createDataFrame([(0, float(k))], "__s int, __k double")
    cut = budget_cut(sums, "__s", "__key", "__rk", "__one", budget, "__k")
    marked = sums.dropDuplicates(["__rk"]).join(F.broadcast(cut), F.col("__s") == F.col("__g"), "left")  # one row
    marked = marked.select("__rk", "log_weight", "noisy_weight", within(F.col("__key"), F.col("__rk")).alias("selected"))
    return rows.drop("log_weight", "noisy_weight", "selected").join(marked, "__rk").drop("__rk")
