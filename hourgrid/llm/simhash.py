"""SimHash near-duplicates by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise
from hourgrid.llm.common import blank_words, lower_word, row_key
from hourgrid.llm.components import components

#: A fingerprint is rotated by these numbers of bits. If two differ in two bits or fewer,
#: their first DEPTH bits are equal after at least one of the rotations.
ROTATIONS, DEPTH = (0, 21, 42), 21
#: Members up to which one pair of trie nodes is traversed in one task.
NODE_ROWS = 50_000
#: Bits by which larger nodes are split before their traversal.
SPLIT_BITS = 7


def shingle_hashes(text: str, n: int = 3):
    """Column of XXH64 (seed 42) hashes of the text's word shingles, repeats included.

    ``text`` names a column of arrays of words."""
    w = F.col(text)
    long = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
    return F.when(F.size(w) >= n, long).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def majority(values: np.ndarray, offsets: np.ndarray, piece: int = 1 << 17) -> np.ndarray:
    """Per list of hashes (int64 ``values`` cut at ``offsets``), the bits set in over half."""
    values, n = values.view(np.uint64), np.diff(offsets)
    ones = np.zeros((64, len(n)), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    base = offsets[0]
    for lo in range(0, len(owner), piece):
        part, own = values[base + lo : base + lo + piece], owner[lo : lo + piece]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for bit in range(64):
            ones[bit, own[starts]] += np.add.reduceat((part >> np.uint64(bit)) & np.uint64(1), starts).astype(np.int64)
    out = np.zeros(len(n), np.uint64)
    for bit in range(64):
        out |= (2 * ones[bit] > n).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            lists = part.column(part.num_columns - 1)
            prints = majority(lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(prints.view(np.int64))], [*part.schema.names[:-1], "__print"])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Columns ``keep`` and ``__print``, the 64-bit SimHash of the text as a long.

    Words and hashes are made by Spark's own functions; numpy counts bits over batches."""
    words = F.transform(blank_words(F.col(text_col)), lower_word)
    return prints_of(docs.select(*keep, words.alias("__w")).select(*keep, shingle_hashes("__w", shingle).alias("__h")))


def prints_of(hashed: DataFrame) -> DataFrame:
    """``hashed`` with its last column, shingle hashes, replaced by their ``__print``."""
    schema = hashed.select(*hashed.columns[:-1], F.lit(0).cast("long").alias("__print")).schema
    return hashed.mapInArrow(_fingerprint_batches, schema)


# -- the trie self-join ----------------------------------------------------------------


def trie_pairs(keys: np.ndarray, starts: np.ndarray, split: np.ndarray, used: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``keys`` that differ in at most ``budget`` bits.

    ``keys`` (uint64) are sorted within the groups that begin at ``starts``. A group is one
    trie node, traversed against itself (``split`` = -1), or two nodes that meet at
    ``split`` and already differ in ``used`` bits. Keys of a node agree in their first
    ``depth`` bits. Pairs of nodes go down together, bit by bit; a pair whose differing
    bits exceed the budget is pruned with all that is below it.
    """
    ends = np.r_[starts[1:], len(keys)]
    one = split < 0
    a0, a1 = starts, np.where(one, ends, split)
    b0, b1 = np.where(one, starts, split), ends
    diff = used.astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(63 - depth, -2, -1):
        # A pair of single leaves is settled by its remaining bits; a leaf with itself is none.
        alone = (a1 - a0 == 1) & (b1 - b0 == 1)
        if alone.any():
            x, y = a0[alone], b0[alone]
            near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= budget)
            found.append((x[near], y[near]))
            a0, a1, b0, b1, diff = (v[~alone] for v in (a0, a1, b0, b1, diff))
        if bit < 0 or not len(a0):
            break
        ones = np.r_[0, np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = a0 != b0
        down = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), tuple(v[other] for v in (am, a1, b0, bm, diff + 1))]
        a0, a1, b0, b1, diff = (np.concatenate(v) for v in zip(*down, strict=True))
        go = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, diff = (v[go] for v in (a0, a1, b0, b1, diff))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _rotate(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    return (values << by) | (values >> ((np.uint64(64) - by) % np.uint64(64)))


def _traverse(depth: int, budget: int, rows: int = NODE_ROWS):
    """The mapInArrow function over (block, a, b, used, print) sorted by node pair: whole
    node pairs are gathered to about ``rows`` and traversed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([c.to_numpy() for c in b.columns]))
            if sum(x.shape[1] for x in held) >= rows:
                table = np.concatenate(held, axis=1)
                last = np.flatnonzero((table[:3] != table[:3, -1:]).any(axis=0))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield _pairs(table[:, :cut], depth, budget)
                held = [table[:, cut:]]
        if held:
            yield _pairs(np.concatenate(held, axis=1), depth, budget)

    return run


def _pairs(table: np.ndarray, depth: int, budget: int) -> pa.RecordBatch:
    block, a, b, used, prints = table
    keys = _rotate(prints.view(np.uint64), np.array(ROTATIONS, np.uint64)[block])
    order = np.lexsort((keys, b, a, block))
    block, a, b, used, prints, keys = (v[order] for v in (block, a, b, used, prints, keys))
    new = np.r_[True, (block[1:] != block[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(block) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    # Nodes are named by their leading bits, so a's members come before b's.
    size = np.add.reduceat((_top(keys, depth) == a).astype(np.int64), starts) if len(starts) else starts
    split = np.where(a[starts] == b[starts], -1, starts + size)
    i, j = trie_pairs(keys, starts, split, used[starts], depth, budget)
    x, y = prints[i], prints[j]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _top(keys: np.ndarray, depth: int) -> np.ndarray:
    return (keys >> np.uint64(64 - depth)).view(np.int64)


def link_prints(prints: DataFrame, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """All pairs (a < b) of fingerprints (column ``__print``, long, distinct) that differ in
    at most ``budget`` (up to 2) bits.

    A binary trie is joined with itself. It is laid out three times, each time with
    another block of bits first: one block is equal in any two near fingerprints, so the
    subtries below a block are traversed apart from each other, on all executors. Nodes
    of more than ``node_rows`` members are split first, into the pairs of their
    descendants that the budget leaves, until none is larger.
    """
    if not 0 <= budget < len(ROTATIONS):
        raise ValueError(f"budget: 0 to {len(ROTATIONS) - 1}")
    block = F.explode(F.array(*[F.lit(i).cast("long") for i in range(len(ROTATIONS))])).alias("block")
    rows = prints.select("__print", block).withColumn("a", F.shiftrightunsigned(_rotated(), 64 - DEPTH))
    rows = rows.select("block", "a", F.col("a").alias("b"), F.lit(0).cast("long").alias("used"), "__print")
    node, found, depth = ["block", "a", "b"], [], DEPTH
    while True:
        large = rows.groupBy(*node).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > node_rows).select(*node)
        large = materialise(large) if depth + SPLIT_BITS < 64 else None
        split = large is not None and large.limit(1).count() > 0
        here = rows.join(large, node, "left_anti") if split else rows
        found.append(here.repartition(*node).sortWithinPartitions(*node).mapInArrow(_traverse(depth, budget), "a long, b long"))
        if not split:
            break
        rows = materialise(_split(rows.join(large, node, "left_semi"), depth, budget))
        depth += SPLIT_BITS
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links.distinct()


def _rotated():
    """``__print`` rotated for its ``block``."""
    turned = [F.shiftleft("__print", r).bitwiseOR(F.shiftrightunsigned("__print", 64 - r)) if r else F.col("__print") for r in ROTATIONS]
    return F.element_at(F.array(*turned), F.col("block").cast("int") + 1)


def _split(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """Members of node pairs, dealt to the pairs of descendants ``SPLIT_BITS`` lower that stay
    within the budget."""
    masks = [(m.bit_count(), m) for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget]
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).cast("long").alias("m")) for n, m in masks])
    rows = rows.withColumns({"__own": F.shiftrightunsigned(_rotated(), 64 - depth), "__low": F.shiftrightunsigned(_rotated(), 64 - depth - SPLIT_BITS)})
    rows = rows.withColumn("__m", F.explode(F.filter(table, lambda t: t["n"] + F.col("used") <= budget)))
    other = F.when(F.col("__own") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    partner = F.shiftleft(other, SPLIT_BITS).bitwiseOR(F.col("__low").bitwiseAND((1 << SPLIT_BITS) - 1).bitwiseXOR(F.col("__m.m")))
    return rows.select("block", F.least("__low", partner).alias("a"), F.greatest("__low", partner).alias("b"), (F.col("used") + F.col("__m.n")).alias("used"), "__print")


# -- the operators ---------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``__rk`` (a key of id and text), ``__print``
    (long) and ``component_id``, the least id that the row's fingerprint reaches over
    links of at most ``budget`` differing bits.

    Rows are folded to distinct fingerprints before any join, so copies cost nothing; a
    fingerprint has a bounded number of others within two bits, so links never grow as
    the square of a group.

    Defined cases: null and empty texts have fingerprint 0 and are linked like any other;
    null ids have no part in the least id, and a component of null ids only has a null
    id; repeated rows stay; an empty table gives an empty table; very long texts are taken
    whole; other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("__id"), row_key(F.col(id_col), F.col(text_col)).alias("__rk"), F.col(text_col).alias("__t"))
    rows = materialise(fingerprints(rows, ["__id", "__rk"], "__t", shingle))
    prints = rows.groupBy("__print").agg(F.min("__id").alias("__first"))
    roots = components(link_prints(prints.select("__print"), budget))
    of = prints.join(roots, F.col("__print") == F.col("node"), "left").select("__print", "__first", F.coalesce("root", "__print").alias("__root"))
    least = of.groupBy(F.col("__root").alias("__r")).agg(F.min("__first").alias("component_id"))
    of = of.join(least, F.col("__root") == F.col("__r")).select(F.col("__print").alias("__p"), "__root", "component_id")
    return rows.join(of, F.col("__print") == F.col("__p")).select(F.col("__id").alias(id_col), "__rk", "__print", "__root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """``docs`` with one document of each component of :func:`near_duplicates`: that of the
    least id (null last; of equal ids the one of least key). Repeated rows are one document."""
    members = near_duplicates(docs, id_col, text_col, shingle, budget)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__rk").alias("key"))
    first = members.groupBy("__root").agg(F.min(order).alias("__first")).select(F.col("__first.key").alias("__rk"))
    return docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col))).join(first, "__rk", "left_semi").dropDuplicates(["__rk"]).drop("__rk")
