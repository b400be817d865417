"""Toxicity scores from class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise
from hourgrid.llm.common import crc_fold
from hourgrid.llm.labelled import labelled_sample, logistic

#: What separates words: ASCII but letters and digits, Latin-1 signs, general and CJK punctuation.
BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\xBF\\u2000-\\u206F\\u3000-\\u303F]+"
#: Labelled documents that the models are fitted on at most. Their words and repeated word pairs go to the driver and to the tasks, 16 bytes each.
MAX_LABELLED = 20_000
#: Occurrences of a word pair in labelled texts that keep it in the models.
LEAST_PAIRS = 2
#: Words of a text with the largest ratios that are features of their own, and words of a span.
TOP, SPAN = 3, 50
#: Words whose ratios a task holds at once, and features of a text.
SLICE_WORDS, FEATURES = 1 << 20, 11
#: The context of a text's first word.
START = 0


def word_ids(text: Column) -> Column:
    """64-bit hashes of the words of ``text``."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def pair_ids(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One 64-bit number for each word and the word before it."""
    v = before.view(np.uint64)
    return (((v << np.uint64(1)) | (v >> np.uint64(63))) ^ words.view(np.uint64)).view(np.int64)


def _pair_id(before: Column, word: Column) -> Column:
    return F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63)).bitwiseXOR(word)


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in sorted ``keys``, at least one, and whether it does."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


@dataclass
class ToxicityModel:
    """Two Kneser-Ney models, see :func:`kneser_ney`; row 0 is of ordinary, row 1 of toxic documents.

    ``keys`` are the sorted hashes of words and ``unigram`` has their P(w); ``contexts`` those that
    begin a pair (``START`` for a text), ``times`` how often, and ``share`` what is kept then for
    words in no pair with it; ``pairs`` are sorted hashes of word pairs, ``seen`` their counts. A
    word that no labelled text holds says nothing, ratio 0: what a model keeps for it
    follows from how many texts of a class there are. ``weights`` turn features into the logit
    of a score."""

    keys: np.ndarray
    unigram: np.ndarray
    contexts: np.ndarray
    times: np.ndarray
    share: np.ndarray
    pairs: np.ndarray
    seen: np.ndarray
    discounts: tuple[float, float] = (0.5, 0.5)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    _sent: Broadcast | None = field(default=None, init=False, repr=False)

    def of_words(self, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-ratios log P(. | toxic) - log P(. | ordinary) of words by themselves and after the
        word before them; ``first``: where texts begin."""
        alone, chained = np.zeros(len(values)), np.zeros(len(values))
        at, known = _find(self.keys, values)
        u = self.unigram[:, at[known]].astype(np.float64)
        alone[known] = np.log(u[1]) - np.log(u[0])
        before = np.r_[START, values[:-1]]
        before[first] = START
        v, found = _find(self.contexts, before[known])
        times, share = np.where(found, self.times[:, v], 0.0), np.where(found, self.share[:, v], 1.0)
        pair, found = _find(self.pairs, pair_ids(before[known], values[known]))
        kept = np.maximum(np.where(found, self.seen[:, pair], 0.0) - np.array(self.discounts)[:, None], 0.0)
        p = kept / np.maximum(times, 1.0) + share * u
        chained[known] = np.log(p[1]) - np.log(p[0])
        return alone, chained

    def features(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text, for words alone and for words after words: the log-likelihood ratio divided
        by its length and by the root of its length, the largest ratio of a word, the sum of
        the ``TOP`` largest and the largest mean of ``SPAN`` words in a row; and log(1 + length)."""
        offsets = offsets.astype(np.int64)
        values, offsets = values[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = np.diff(offsets)
        some = np.flatnonzero(n)
        out = np.zeros((len(n), FEATURES))
        out[:, -1] = np.log1p(n)
        if not len(some):
            return out
        length, first = n[some], offsets[:-1][some]
        owner = np.repeat(np.arange(len(some)), length)
        width = np.minimum(length, SPAN)
        # A span begins wherever its text goes on for its width.
        begins = np.flatnonzero(np.arange(len(values)) + width[owner] <= (first + length)[owner])
        spans = np.flatnonzero(np.r_[True, owner[begins][1:] != owner[begins][:-1]])
        for k, own in enumerate(self.of_words(values, first)):
            total = np.r_[0.0, np.cumsum(own)]
            sums = total[first + length] - total[first]
            order = np.lexsort((-own, owner))
            top = np.zeros((len(some), TOP))
            for i in range(TOP):
                more = length > i
                top[more, i] = own[order[first[more] + i]]
            means = (total[begins + width[owner[begins]]] - total[begins]) / width[owner[begins]]
            out[some, 5 * k : 5 * k + 5] = np.c_[sums / length, sums / np.sqrt(length), top[:, 0], top.sum(axis=1), np.maximum.reduceat(means, spans)]
        return out

    def sent(self, spark: SparkSession) -> Broadcast:
        """This model on its way to the tasks, once for all jobs; its weights are not read there."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(replace(self))
        return self._sent


def discount(once: float, twice: float) -> float:
    """The absolute discount of Kneser-Ney, below one, from how many things were seen once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``SLICE_WORDS`` words (a longer text is one of its own), with values and offsets of their last column, a list."""
    for b in batches:
        lists = b.column(b.num_columns - 1)
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        lo = 0
        while lo < b.num_rows:
            hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_WORDS, "right")) - 1), b.num_rows)
            yield b.slice(lo, hi - lo), values, offsets[lo : hi + 1]
            lo = hi


def score_of(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -35, 35)))


def _features(sent: Broadcast, weights: np.ndarray | None, names: list[str]):
    """Features of texts, or scores if there are ``weights``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in _slices(batches):
            x = sent.value.features(values, offsets)
            new = [pa.array(c) for c in np.ascontiguousarray(x.T)] if weights is None else [pa.array(score_of(x, weights))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names)

    return run


def count_pairs(texts: DataFrame) -> DataFrame:
    """(``v``, ``w``, ``n0``, ``n1``): how often word w follows v in texts (``__y`` 0 or 1, ``__w`` word ids) of either class."""
    before = lambda i: F.coalesce(F.get("__w", i - 1), F.lit(START).cast("long"))
    two = F.explode(F.transform("__w", lambda w, i: F.struct(before(i).alias("v"), w.alias("w")))).alias("p")
    return texts.select("__y", two).groupBy("p.v", "p.w").agg(*[F.count(F.when(F.col("__y") == y, 1)).alias(f"n{y}") for y in (0, 1)])


def kneser_ney(pairs: DataFrame, shared: DataFrame, least: int = LEAST_PAIRS) -> ToxicityModel:
    """Two interpolated Kneser-Ney models, one of each class.

    ``pairs`` is of :func:`count_pairs`, ``shared`` (``w``, ``n``) has the counts that both models
    back off to. For class y, with discounts D from that class's counts of counts,

    * P(w | v) = max(n_y(v, w) - D, 0) / n_y(v) + S_y(v) P(w), P(w) where v was not seen;
    * P(w) = max(N_y(. w) - D, 0) / N_y(. .) + D V_y / N_y(. .) Q(w), Q(w) without any pair;
    * Q(w) = (n(w) + 1/2) / sum of the same over all words and an unseen one,

    where N_y(. w) are the distinct words before w, V_y the words of the class, and S_y(v) what
    the first terms leave of 1. Pairs that both classes together hold fewer than ``least`` times
    are pruned from the first term, as large models are; S_y gets their mass. So an expression that a class saw rarely gets what its counts in the
    whole corpus say, and the same in both classes if neither saw it.
    """
    y2 = [F.col(f"n{y}") > 0 for y in (0, 1)]
    before = pairs.groupBy("w").agg(*[F.count(F.when(y2[y], 1)).alias(f"k{y}") for y in (0, 1)])
    times = lambda c, n: F.count(F.when(F.col(c) == n, 1))
    p = pairs.agg(*[times(f"n{y}", n).alias(f"{y}{n}") for y in (0, 1) for n in (1, 2)]).first()
    b = before.agg(*[times(f"k{y}", n).alias(f"{y}{n}") for y in (0, 1) for n in (1, 2)], *[F.coalesce(F.sum(f"k{y}"), F.lit(0)).alias(f"all{y}") for y in (0, 1)], *[F.count(F.when(F.col(f"k{y}") > 0, 1)).alias(f"types{y}") for y in (0, 1)]).first()
    total, size = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    d2, d1 = [discount(p[f"{y}1"], p[f"{y}2"]) for y in (0, 1)], [discount(b[f"{y}1"], b[f"{y}2"]) for y in (0, 1)]
    left = [d1[y] * b[f"types{y}"] / b[f"all{y}"] if b[f"all{y}"] else 1.0 for y in (0, 1)]
    kept = F.col("n0") + F.col("n1") >= least
    own = [F.sum(F.when(kept, F.greatest(F.col(f"n{y}") - F.lit(d2[y]), F.lit(0.0))).otherwise(F.lit(0.0))).alias(f"h{y}") for y in (0, 1)]
    after = pairs.groupBy("v").agg(*[F.sum(f"n{y}").alias(f"c{y}") for y in (0, 1)], *own, F.max(kept).alias("kept")).filter("kept")
    after = after.select("v", *[F.col(f"c{y}").cast("float") for y in (0, 1)], *[(F.lit(1.0) - F.col(f"h{y}") / F.greatest(f"c{y}", F.lit(1))).cast("float").alias(f"s{y}") for y in (0, 1)])
    q = (F.col("n") + 0.5) / F.lit(total + 0.5 * size + 0.5)
    seen = [F.greatest(F.col(f"k{y}") - F.lit(d1[y]), F.lit(0.0)) / F.lit(float(b[f"all{y}"] or 1)) for y in (0, 1)]
    words = before.join(shared, "w").select("w", *[(seen[y] + F.lit(left[y]) * q).cast("float").alias(f"u{y}") for y in (0, 1)])
    two = pairs.filter(kept).select(_pair_id(F.col("v"), F.col("w")).alias("k"), *[F.col(f"n{y}").cast("float") for y in (0, 1)])
    # Words and pairs of at most so many labelled documents as the caller has sampled.
    one, after, two = words.toArrow().sort_by("w"), after.toArrow().sort_by("v"), two.toArrow().sort_by("k")
    column = lambda t, c, none: t[c].to_numpy() if len(t) else np.array([none])
    both = lambda t, c, none: np.stack([column(t, f"{c}{y}", none) for y in (0, 1)])
    return ToxicityModel(column(one, "w", START), both(one, "u", 1.0), column(after, "v", START), both(after, "c", 0.0), both(after, "s", 1.0), column(two, "k", 0), both(two, "n", 0.0), tuple(d2))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on at most ``max_labelled`` labelled rows that are not held out.

    Pairs of words of folds 1 to 3 make one Kneser-Ney model of toxic and one of ordinary
    documents (:func:`kneser_ney`); the counts that both back off to are, for each word,
    all documents of ``docs`` that hold it, a table that grows with the corpus. Fold 4
    calibrates the score from :meth:`ToxicityModel.features`: length-normalised
    ratios of the whole text, and of its most telling words and span, so that a short
    expression counts in a long text.

    The driver gets words and pairs of the labelled documents, which ``max_labelled``
    bounds. Defined cases: null ids and labels are no labels, null and empty texts have no
    words, very long ones are counted whole, a repeated row of a labelled id counts each
    time; without labels of both classes, and on empty tables, all texts of a length score
    alike; other columns are not read, whatever their names.
    """
    sample = F.broadcast(materialise(labelled_sample(labels, label_col, id_col, max_labelled)))  # at most max_labelled rows
    words = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    every = materialise(words.select(F.explode(F.array_distinct(word_ids(F.col("__t")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    own = words.join(sample, "__id").select("__y", "__fold", word_ids(F.col("__t")).alias("__w"))
    model = kneser_ney(materialise(count_pairs(own.filter("__fold < 4"))), every)
    names = [f"f{i}" for i in range(FEATURES)]
    held = own.filter("__fold = 4").select("__y", "__w").mapInArrow(_features(model.sent(docs.sparkSession), None, ["y", *names]), f"y int, {', '.join(f'{n} double' for n in names)}")
    table = np.array(sorted(held.collect())).reshape(-1, FEATURES + 1)  # part of the sample
    model.weights = logistic(table[:, 1:], table[:, 0])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``held_out``, ``score``, ``predicted``) per row of ``docs``: ``score`` (0 to 1)
    grows with the odds that the toxic model wrote the text; ``predicted`` is score >= 0.5.

    Only the text enters the score. No shuffle: the model, of bounded size, goes with the
    tasks; a task holds the ratios of about a million words, or of one longer text.
    Defined cases: null and empty texts get the score of a text without evidence; repeated
    rows get equal scores; null ids are not held out and never labelled; an empty table
    gives an empty table; other columns are left out, whatever their names.
    """
    held_out = (crc_fold(F.col(id_col)) == 0) & F.col(id_col).isNotNull()
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), word_ids(F.col(text_col)).alias("__w"))
    schema = docs.select(F.col(id_col), held_out.alias("held_out"), F.lit(0.0).alias("score")).schema
    scored = rows.mapInArrow(_features(model.sent(docs.sparkSession), model.weights, [id_col, "held_out", "score"]), schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
