"""Near copies by exact shingle similarity against brute force, and on edge rows."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from hourgrid.llm import near_copies

from .test_pairs_and_lines import ascii_lower, frame


def shingle_set(t, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", ascii_lower(t or "")) if x]
    return frozenset(" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_copies(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def planted_copies(rng, i, tries):
    """Rows of a base text, its copies with ever more changed words, and copies of copies."""
    base = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([30, 90, 200]))]
    rows, last = [(i, " ".join(base))], base
    for k in range(1, tries):
        w = list(last if k % 3 == 0 else base)
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [f"new{rng.randrange(50)}"]
        last = w
        rows.append((i + k, " ".join(w)))
    return rows


def test_near_copies_match_brute_force(spark):
    rng = random.Random(9)
    rows = [r for g in range(12) for r in planted_copies(rng, 100 * g, 12)]
    stock = [" ".join(f"s{p}x{k}" for k in range(20)) for p in range(8)]
    rows += [(5000 + i, " ".join(rng.sample(stock, 5))) for i in range(40)]
    rows += [(6000, None), (6001, ""), (6002, " \n"), (6003, "three words only"), (6004, "Three WORDS\tonly"), (6005, "a b c d e"), (6006, "a b c d f")]
    rng.shuffle(rows)
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == brute_copies(rows)


def test_pipeline_drops_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50] + ["other"] + words[51:])), (3, " ".join(words[:150] + ["x", "y"] + words[150:])), (4, " ".join(words[:100]))]
    rows = [(i, t, "en", "a", len(t)) for i, t in rows]
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").orderBy("doc_id").collect()] == [1, 4]


def test_near_copies_edge_rows(spark):
    df = frame(spark).withColumns({"a": F.lit(1), "node": F.lit(2), "root": F.lit(3)})
    kept = near_copies.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert near_copies.drop_near_copies(frame(spark, [])).count() == 0


def test_texts_put_together_of_shared_passages(spark, monkeypatch):
    """Many texts share each passage, few share enough of them; large groups are dealt to blocks."""
    rng = random.Random(12)
    passages = [" ".join(f"p{p}w{rng.randrange(10**6)}" for _ in range(30)) for p in range(9)]
    rows = [(i, " ".join(rng.sample(passages, rng.choice([4, 5, 6])))) for i in range(260)]
    rows += [(300 + i, t + " and a few words more") for i, (_, t) in enumerate(rows[:30])]
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(r.doc_id for r in kept.collect()) == brute_copies(rows)


def test_groups_of_the_same_texts_are_one(spark):
    """Twenty shingles that just the same texts hold give one group's pairs, those of the first shingle."""
    named = [(k, 100, 100, 0.0, [0] * near_copies.BITMAP, at, 50 + at, k) for k in range(6) for at in range(20)]
    named += [(k, 100, 100, 0.0, [0] * near_copies.BITMAP, 20, 90, k) for k in range(3)]
    df = spark.createDataFrame(named, "__k long, __n int, __c int, __w double, __bits array<long>, __at int, __t long, __r long")
    pairs = near_copies._open_pairs(df, 0.8).select("__t", "__k", "b", "__at").collect()
    first = [(r["__k"], r.b) for r in pairs if r["__t"] == 50]
    assert sorted(first) == [(i, j) for i in range(6) for j in range(i + 1, 6)] and {r["__t"] for r in pairs} <= {50, 90} and len(pairs) == 15
