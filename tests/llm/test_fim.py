"""Fill-in-middle against a plain implementation, on odd rows and other character classes."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.llm.fim import CharClass, RunEncoder, fill_in_middle, restored_text
from tests.llm.test_pairs_and_lines import EDGE, frame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=50, spm=80, seed="42"):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    pieces = ["a", "word", "ÀÉ", "𝄞𝄞", " ", "  ", "\t", "\n", "\x0b", "\x0c\r", "\x1c", "\u00a0", "\u3000", "漢字", "<P", ">", "<S>", "<", "M>", "\x00", "e\u0301"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    return rows + [(1000, " "), (1001, "a "), (1002, " a"), (1003, "<<S"), (1004, "x<P"), (1005, "\u0085 \u2028"), (1006, "w " * 200_000), (1007, "w" * 300_000), (1008, " " * 300_000)]


def test_cuts_match_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for rate, spm in ((50, 80), (100, 40)):
        got = {r.doc_id: tuple(r)[1:] for r in fill_in_middle(df, rate=rate, spm=spm).collect()}
        assert got == {i: brute(i, t, rate, spm) for i, t in rows}


def test_texts_come_back(spark):
    rows = texts()
    made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100)
    back = {r.doc_id: r.back for r in made.select("doc_id", restored_text(F.col("output"), F.col("form")).alias("back")).collect()}
    assert back == dict(rows)
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    odd = ("{{p", "|s+", ".*")  # markers that mean something to a regular expression
    made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100, markers=odd)
    assert {r.doc_id: r.back for r in made.select("doc_id", restored_text(F.col("output"), F.col("form"), odd).alias("back")).collect()} == dict(rows)


def test_markers_must_be_told_apart(spark):
    for odd in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError, match="markers"):
            fill_in_middle(spark.createDataFrame([(1, "x")], "doc_id long, text string"), markers=odd)


def test_edge_rows(spark):
    df = frame(spark).withColumns({"n": F.lit("clash"), "form": F.lit(1), "output": F.lit(2), "h1": F.lit("mine"), "run_chars": F.lit(0)})
    made = fill_in_middle(df)
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted(((r[0], *brute(r[0], r[1])) for r in EDGE), key=str)
    assert fill_in_middle(frame(spark, []), keep_runs=True).count() == 0


def test_runs_are_kept_with_their_units(spark):
    df = spark.createDataFrame([(1, "ab  cd "), (2, None), (3, " x"), (4, "\t\n")], "doc_id long, text string")
    got = {r.doc_id: (r.run_chars, r.run_units) for r in fill_in_middle(df, keep_runs=True).collect()}
    assert got == {1: ([2, 4, 6, 7], [1, 1, 2, 3]), 2: ([], []), 3: ([1, 2], [0, 1]), 4: ([2], [1])}


def test_units_of_several_characters():
    """Digits in units of three, others one by one, blanks to the next unit."""
    classes = (CharClass(width=1), CharClass(((0x20, 0x20),), joins_next=True), CharClass(((0x30, 0x39),), width=3))
    unit = re.compile(r" *(?:\d{1,3}|[^ \d])| +")
    rng = random.Random(4)
    many = ["".join(rng.choice("ab 0123é") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    runs, starts = RunEncoder(classes).encode(many)
    # A unit of digits begins where its run does, so the pattern must not look across runs.
    want = [unit.findall(t) for t in many]
    assert runs.units().tolist() == [len(w) for w in want]
    for share in (0.0, 0.3, 0.7, 1.0):
        cuts = np.array([int(share * len(w)) for w in want])
        assert runs.offsets(starts[:-1], cuts).tolist() == [len("".join(w[:c])) for w, c in zip(want, cuts)]
