"""Line dedup, decontamination, SimHash and mixing against brute force, and on edge rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hourgrid.llm import simhash
from hourgrid.llm.components import components
from hourgrid.llm.decontam import find_overlaps
from hourgrid.llm.line_dedup import dedup_lines
from hourgrid.llm.mixing import cycle_weights, mix_sources, source_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that every operator must take: null and empty cells, repeats, ties, odd characters.
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", "a", 1), (3, " \t\n ", None, "b", 4), (4, "Same text.\nSame text.", "en", "b", 1), (4, "Same text.\nSame text.", "en", "b", 1), (5, "ÀÉ Kİ é\u0000x", "fr", None, 3), (6, "w " * 3000, "en", "a", 6000)]


def frame(spark, rows=EDGE):
    return spark.createDataFrame(rows, DOCS)


def ascii_lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


# -- line dedup


def brute_lines(rows, least=10):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    gone = {k for k, v in docs.items() if k and len(v) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(1)
    pool = ["Shared LINE", "  shared line\t", "other", "", "É", "é", "x y", "tail \r"]
    rows = [(i % 55, "\n".join(rng.choice(pool + [f"own {i}"]) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(99, None), (98, "")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == Counter(brute_lines(rows))


def test_lines_edge_rows(spark):
    df = frame(spark).withColumns({"n_lines": F.lit("clash"), "pos": F.lit(1), "key": F.lit(2)})
    got = dedup_lines(df, min_docs=1)
    assert got.columns == df.columns + ["n_dropped"] and got.count() == len(EDGE)
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.filter("doc_id in (1, 4)").collect()} == {(1, 1, 0, ""), (4, 2, 2, "")}
    assert dedup_lines(frame(spark, [])).count() == 0


# -- decontamination


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or "")) if w]


def brute_overlap(docs, bench, span=10):
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for item, text in bench:
            b = words(text)
            n = min(len(b), span)
            for k in range(len(b) - n + 1) if b else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == b[k : k + n]:
                        hit |= set(range(s, s + n))
                        items.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), tuple(sorted(items))))
    return out


@pytest.mark.parametrize("span", [10, 6])
def test_overlaps_match_brute_force(spark, span):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(25)]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(12)] + [(50, None), (None, "lone words here"), (51, "W1 W1 W1 W1 W1 W1 W1 W1 W1 W1 W1 W1")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        b = words(rng.choice(bench)[1])
        if b:
            a = rng.randint(0, len(b) - 1)
            p = rng.randint(0, len(w))
            w[p:p] = b[a : a + rng.randint(1, 20)]
        docs.append((i, ", ".join(w).upper() if i % 2 else " ".join(w)))
    docs += [(100, "w1 " * 200), (101, None), (102, ""), (103, "lone WORDS-here"), (103, "lone WORDS-here")]
    got = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), span=span).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter(brute_overlap(docs, bench, span))
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)


def test_overlaps_edge_rows(spark):
    df = frame(spark).withColumns({"items": F.lit("clash"), "item_id": F.lit(1), "start": F.lit(2)})
    none = spark.createDataFrame([], "item_id long, text string")
    got = find_overlaps(df, none)
    assert got.count() == len(EDGE) and got.filter("contaminated or n_hit > 0").count() == 0
    assert find_overlaps(frame(spark, []), none).count() == 0
    long = find_overlaps(df, spark.createDataFrame([(7, "w " * 12)], "item_id long, text string")).filter("contaminated").collect()
    assert [(r.doc_id, r.n_hit) for r in long] == [(6, 3000)]


# -- SimHash


def fingerprint(t, n=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", ascii_lower(t or "")) if x]
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    ones = np.zeros(64, int)
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        ones += np.array([h >> b & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def brute_components(ids, prints, budget=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return {i: min((x for x in g if x is not None), default=None) for g in groups.values() for i in g}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        w = [f"t{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 2, 3, 60, 120]))]
        rows.append((i, " ".join(w)))
        if len(w) > 50:
            w[rng.randrange(len(w))] = "CHANGED"
            rows.append((100 + i, "\n".join(w)))
    rows += [(500, None), (501, "Same Same"), (502, "same\tsame"), (502, "same\tsame")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: fingerprint(t) for i, t in rows}
    assert len(got) == len(rows) and all(r["__print"] & (1 << 64) - 1 == want[r.doc_id] for r in got)
    comp = brute_components(list(want), list(want.values()))
    assert {r.doc_id: r.component_id for r in got} == comp


@pytest.mark.parametrize("node_rows", [50_000, 8])
def test_trie_join_finds_every_link(spark, node_rows):
    rng = random.Random(4)
    prints = set()
    for _ in range(20):
        b = rng.getrandbits(64)
        for _ in range(30):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = [p - (1 << 64) if p >> 63 else p for p in prints | {0, (1 << 64) - 1}]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = simhash.link_prints(spark.createDataFrame([(p,) for p in prints], "__print long"), 2, node_rows).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)} | {2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    df = frame(spark).withColumns({"fingerprint": F.lit(1), "block": F.lit(2), "a": F.lit(3)})
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


# -- mixing


def brute_targets(sizes, weights, share=1.5, cap=2.0):
    goal, full = share * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        left = goal - sum(full.values())
        t = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in t if t[s] > cap * sizes[s]]
        if not over:
            return full | t
        full |= {s: cap * sizes[s] for s in over}


def test_targets_match_repeated_resharing(spark):
    rng = random.Random(5)
    for k in range(6):
        sizes = {f"s{i:02d}": rng.choice([0, 5, 100, 1000, 7]) + (i == 0) for i in range(rng.randint(1, 9))}
        weights = {s: [3.0, 1.0, 2.0][i % 3] for i, s in enumerate(sorted(sizes))}
        df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "s string, source_size long, weight double")
        got = {r.s: r.target for r in source_targets(df, 1.5, 2.0).collect()}
        assert got == pytest.approx(brute_targets(sizes, weights))


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([1, 5, 30, 200]))), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(300)]
    got = mix_sources(frame(spark, rows), (3.0, 1.0, 2.0)).collect()
    again = mix_sources(frame(spark, rows[::-1]).repartition(3), (3.0, 1.0, 2.0)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}
    assert all(r.taken <= 2 * r["size"] and r.taken == r.times * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r["size"] for r in rs) / 2 + 1
        assert len({min(r.times, 1) if rs[0].target < rs[0].source_size else r.times >= 1 for r in rs}) >= 1
    weights = {r.source: r.weight for r in cycle_weights(frame(spark, rows), "source", (3.0, 1.0, 2.0)).collect()}
    assert weights == {"a": 3.0, "b": 1.0, "c": 2.0, None: 3.0}


def test_mix_edge_rows(spark):
    df = frame(spark).withColumns({"target": F.lit("clash"), "weight": F.lit(0), "times": F.lit(9)})
    got = mix_sources(df, (3.0, 1.0, 2.0))
    assert got.count() == len(EDGE) and set(df.columns) <= set(got.columns)
    assert {(r["size"], r.taken) for r in got.filter("doc_id in (1, 2, 3)").collect()} == {(0, 0)}
    assert mix_sources(frame(spark, []), (3.0, 1.0, 2.0)).count() == 0


def test_sampling_prefers_heavy_documents(spark):
    rows = [(i, "w w w w", "en", "a", 0) for i in range(400)]
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    got = mix_sources(frame(spark, rows), weights, share=0.5, quality=F.when(F.col("doc_id") < 100, 8.0).otherwise(1.0)).collect()
    heavy = sum(r.times for r in got if r.doc_id < 100)
    assert sum(r.times for r in got) == 200 and heavy > 80
    assert math.isclose(got[0].target, 800)


def test_digests_are_hex(spark):
    row = find_overlaps(frame(spark, [(1, "x", None, None, 1)]), spark.createDataFrame([(1, "x")], "item_id long, text string")).select(F.sha2(F.array_join("items", ","), 256)).first()
    assert row[0] == hashlib.sha256(b"1").hexdigest()
