"""The filter audit against counting every document through every order."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from hourgrid.llm.filter_audit import audit_filters, subset_survivors
from tests.llm.test_pairs_and_lines import EDGE, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def failing(rows, k=5):
    """The letters that each row fails."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        out.append({c for c, b in zip("ABCDE"[:k], bad) if b})
    return out


def brute(rows, labels, k=5):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    rows = [(i, t, s or "") for i, t, s in rows]
    fails = failing(rows, k)
    out, shapley = {}, {}
    for part in {s for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails) if s == part]
        for order in map("".join, permutations("ABCDE"[:k])):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                every = sum(c in f for _, f in own)
                out[part, order, step] = (len(left), len(gone), every - len(gone), sum(f == {c} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def a_corpus():
    rng = random.Random(9)
    words = ["alpha", "Beta", "GAMMA", "été", "x#", "50%", "plain", "words", "and", "more"]
    pool = [" ".join(rng.choice(words[: rng.randint(1, 10)]) + str(rng.randint(0, 150)) * rng.randint(0, 1) for _ in range(rng.choice([3, 199, 200, 230]))) for _ in range(60)]
    pool += ["same text\n" * 30, "same text\n" * 120, "", " \t"]
    rows = [(i, rng.choice(pool), rng.choice(["a", "a", "a", "b", None, ""])) for i in range(500)]
    rows += rows[:40] + [(None, pool[0], "a"), (None, None, "b"), (7, None, "a"), (7, pool[1], "b")]
    labels = [(rng.randint(0, 520), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(400)] + [(None, 1, 1)]
    return rows, labels


def test_audit_matches_brute_force(spark):
    rows, labels = a_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = collected(audit_filters(docs, spark.createDataFrame(labels, LABELS)))
    assert got == brute(rows, labels)
    assert len(got) == 3 * 600


def test_other_filters_and_no_copies(spark):
    rows, labels = a_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = {"A": F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) < 200, "B": F.lit(None).cast("boolean")}
    got = collected(audit_filters(docs, spark.createDataFrame(labels, LABELS), bad, copies=None))
    one = [f & {"A"} for f in failing(rows)]
    assert got["a", "BA", 2][1] == sum("A" in f for f, r in zip(one, rows) if r[2] == "a") and got["a", "BA", 1][1] == 0
    for wrong in ({"A": F.lit(True)}, {c: F.lit(True) for c in "ABCDFG"}, {}):
        with pytest.raises(ValueError, match="distinct letters"):
            audit_filters(docs, spark.createDataFrame(labels, LABELS), wrong, copies="A")


def test_survivors_of_every_subset(spark):
    rng = random.Random(2)
    masks = [(p, m, rng.randint(0, 9)) for p in "xy" for m in range(8) if rng.random() < 0.7]
    got = {r.part: r.s_n for r in subset_survivors(spark.createDataFrame(masks, "part string, mask int, n long"), 3, ("n",)).collect()}
    assert got == {p: [sum(n for q, m, n in masks if q == p and not m & s) for s in range(8)] for p in {p for p, *_ in masks}}


def test_edge_rows(spark):
    df = frame(spark).withColumns({c: F.lit(1) for c in ("part", "mask", "good", "toxic", "n", "quality", "step")})
    labels = [(4, 1, 0), (4, 0, 1), (6, 1, 1), (None, 1, 1)]
    got = collected(audit_filters(df, spark.createDataFrame(labels, LABELS)))
    assert got == brute([(r[0], r[1], r[3]) for r in EDGE], labels)
    assert audit_filters(frame(spark, []), spark.createDataFrame([], LABELS)).count() == 0
    assert collected(audit_filters(frame(spark), spark.createDataFrame([], LABELS)))["a", "ABCDE", 1][4:6] == (0, 0)


def test_a_text_of_a_third_of_all_rows_is_folded_before_it_is_shuffled(spark):
    """The rows of one text that reach the window of its copies are one for each part and kind of label."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    got = collected(audit_filters(docs, spark.createDataFrame([], LABELS)))
    assert got["a", "EABCD", 1][1] == 999
    plan = audit_filters(docs, spark.createDataFrame([], LABELS))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
