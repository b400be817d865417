"""Secret candidates: their forms, features against a plain implementation, long ones and edge rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hourgrid.llm import secrets

from .test_pairs_and_lines import EDGE, frame

SCHEMA = "doc_id long, text string, source string"


def test_forms_of_credentials_are_found(spark):
    rng = random.Random(41)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    make = lambda n, chars=alphabet: "".join(rng.choice(chars) for _ in range(n))
    forms = ['password = "{}"', "Password: {}", "api_key='{}'", "SECRET={} ", "auth: `{}`", "db_passwd = {}", "the access-key: {} is"]
    rows, want = [], {}
    for i in range(210):
        value = [make(rng.randint(5, 10)), make(9, alphabet + "!@$%&*"), make(40), f"{make(20)}.{make(30)}1.{make(25)}", make(8, alphabet[:26])][i % 5]
        rows.append((i, f"some words {forms[i % 7].format(value)} more words", None))
        want[i] = value
    rows += [(1000 + i, "a sentence: with words = and signs, the token ring and key notes about passwords", None) for i in range(20)]
    got = {}
    for r in secrets.candidates(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r.candidate)
    assert sum(v in got.get(i, []) for i, v in want.items()) / len(want) >= 0.99
    assert not any(i >= 1000 for i in got)


def plain_coverage(text, words):
    hit = set()
    for i in range(len(text)):
        for w in words:
            if text[i : i + len(w)].lower() == w:
                hit |= set(range(i, i + len(w)))
    return len(hit) / len(text)


def test_features_match_a_plain_implementation(spark):
    rng = random.Random(42)
    words = ["the", "cat", "release", "them", "hex", "abcdefghijkl"]
    texts = ["9releasethemcat_The", "abc123ABC123aaa", "0123456789abcdef", "1".join(rng.choice([*words, "x", "ZZ"]) for _ in range(400)), "abcdefghijkl" * 70 + "1"]
    docs = spark.createDataFrame([(i, f"word {t} then", "a/b.c") for i, t in enumerate(texts)], SCHEMA)
    found = secrets.candidates(docs)
    rows = {r.doc_id: r for r in secrets.features(found, spark.createDataFrame([(w,) for w in words], "__word string")).collect()}
    for i, t in enumerate(texts):
        r, n = rows[i], len(t)
        assert r.candidate == t and r.length == n and r["__path"] == ["a", "b", "c"] and r["__near"] == ["<word", "=", ">then"]
        assert r.coverage == pytest.approx(plain_coverage(t, words))
        for name, pattern in (("digits", "[0-9]"), ("upper", "[A-Z]"), ("lower", "[a-z]"), ("other", "[^A-Za-z0-9]"), ("turns", "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"), ("repeats", r"(.)(?=\1)")):
            assert r[name] == pytest.approx(len(re.findall(pattern, t)) / n)
        assert r.distinct == pytest.approx(len(set(t)) / min(n, 64))


def test_hidden_words_stay_out_of_the_neighbours(spark):
    docs = spark.createDataFrame([(1, 'token = "abc123abc123" x', "a"), (2, "see abc123abc124 x", "a")], SCHEMA)
    rows = {r.doc_id: r["__near"] for r in secrets.features(secrets.candidates(docs), spark.createDataFrame([], "__word string"), rf"{secrets.NAMES}$").collect()}
    assert rows == {1: ["<", ">x"], 2: ["<see", ">x"]}


def test_long_texts_candidates_and_neighbours(spark):
    long = "the1" * 30_000
    docs = spark.createDataFrame([(1, f"{'w' * 5000}: {long} {'v' * 5000}", "p"), (2, "y" * 300_000, "p")], SCHEMA)
    got = secrets.scan_secrets(docs).collect()
    assert [(r.doc_id, len(r.candidate), r.before, r.after, r.score) for r in got] == [(1, 120_000, "w" * 5000, "v" * 5000, 0.5)]


def test_secret_edge_rows(spark):
    empty = secrets.scan_secrets(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "pos", "candidate", "path", "before", "after", "label", "score", "is_secret"]
    rows = EDGE + [(7, "key = abc", None, None, 1), (8, 'key = "abcd"', None, None, 1), (8, 'key = "abcd"', None, None, 1)]
    got = secrets.scan_secrets(frame(spark, rows).withColumns({"candidate": F.lit("clash"), "score": F.lit(1)})).collect()
    assert [(r.doc_id, r.candidate, r.path) for r in got] == [(8, "abcd", None)] * 2
