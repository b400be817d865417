"""URL filters: parts and rules against plain code, the classifier against numpy and held-out names."""

import re
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.llm.url_filter import LENGTHS, RULES, filter_urls, fit_urls, fitting_rule, labelled_urls, url_parts, with_ngrams

URLS = [
    None, "", "no scheme", "example.com/en/", "http://", "http:///en/1", "https://Example.COM/en/1", "https://www.example.com/en/1?x=/en/", "https://a.www.example.com/en/", "https://example.com", "https://example.com?/en/",
    "https://example.com#/en/", "https://xexample.com/en/1", "https://b.example.com/EN/1", "https://site.net/es/1", "https://net/es/", "https://m.site.net/fr/9#a", "https://site.net/de/1", "https://a.net/es", "ftp://É.net/fr/é?q",
    "https://a.org/x://b.com/en/", "https://user@host.com:80/p", "https://com/", "https://com", "https://x.com\n/a\nb?c", "https://İ.COM/İ", "://a.com/b", "https://a.comx/", "https://.com/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after)[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), re.match(r"[^?#]*", after[len(host) :])[0]


def rule_of(host, path):
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


@pytest.fixture(scope="module")
def model(spark):
    return fit_urls(labelled_urls(spark))


def grams(host, path):
    out = set()
    for name, part in (("h", host), ("p", path)):
        t = "^" + re.sub("[1-9]", "0", part.lower()) + "$"
        out |= {name + t[i : i + n] for n in LENGTHS for i in range(len(t) - n + 1)}
    return out


def test_parts_and_rules_match_plain_code(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    host, path = url_parts(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict")).collect()}
    for i, u in enumerate(URLS):
        h, p = parts(u)
        assert got[i] == (h, p, *rule_of(h, p)), u
    with pytest.raises(ValueError, match="differ"):
        fitting_rule(F.lit(""), F.lit(""), (("allow", "a", "/"), ("block", "a", "/")))


def test_grams_match_plain_code(spark):
    rows = [("www.site24.org", "/en/10/"), ("", ""), ("a", "/é漢"), ("x", "/" + "ab/" * 20_000)]
    df = spark.createDataFrame(rows, "host string, path string")
    got = with_ngrams(df, F.col("host"), F.col("path")).collect()
    assert [set(r["__grams"]) for r in got] == [grams(h, p) for h, p in rows]


def test_scores_are_those_of_the_weights(spark, model):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    hashed = model.stages[0].transform(with_ngrams(df, *url_parts(F.col("url")))).select("url", "__x").collect()
    w, b = model.stages[1].coefficients.toArray(), model.stages[1].intercept
    want = {r.url: 1 / (1 + np.exp(-(w[r["__x"].indices].sum() + b))) for r in hashed}
    assert {r.url: r.score for r in filter_urls(df, model).collect()} == pytest.approx(want)


def test_names_that_were_not_in_the_labelled_table(spark, model):
    bad = ["online-casino-de", "bestpoker", "hot-adult", "lottery24", "cheapviagra", "spammer-net", "popup-world", "adtracker", "sports-betting", "jackpots", "porntube-hd"]
    good = ["libraries", "uni-press", "stadtbibliothek", "shakespeare", "cookingclub", "lakewood", "thedaily", "erthble", "reedand", "gardens", "tionhand", "museumofart"]
    rows = [(f"https://www.{n}.example.{z}{p}", y) for y, names in ((1, bad), (0, good)) for n in names for z in ("net", "org") for p in ("/en/123", "/de/9.html?x=1")]
    known = {u for u, _ in labelled_urls(spark).collect()}
    assert not known & {u for u, _ in rows}
    scored = filter_urls(spark.createDataFrame(rows, "url string, y int"), model).collect()
    right = sum((r.score >= 0.5) == (r.y == 1) for r in scored)
    assert right >= 0.9 * len(rows)
    # Rules come first, whatever the score.
    assert all(r.verdict == ("allow" if r.rule == "com/" else r.verdict) for r in scored)


def test_edge_rows(spark, model):
    rows = [(1, None), (2, "no scheme"), (3, "https://casino.org/"), (3, "https://casino.org/"), (None, "https://a.com/x"), (5, "https://x.org/" + quote("é") * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "score", "verdict", "probability", "prediction", "rawPrediction", "features")})
    out = filter_urls(df, model)
    assert out.columns == ["page_id", "url", "probability", "prediction", "rawPrediction", "features", "host", "path", "rule", "score", "verdict"]
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted([(1, "", None, "allow"), (2, "", None, "allow"), (3, "casino.org", None, "block"), (3, "casino.org", None, "block"), (None, "a.com", "com/", "allow"), (5, "x.org", None, "allow")], key=str)
    assert filter_urls(df.limit(0), model).count() == 0


def test_labels_that_cannot_be_learnt_from(spark):
    page = spark.createDataFrame([("https://a.org/b",)], "url string")
    empty = fit_urls(spark.createDataFrame([(None, 1), ("https://a.org/", None)], "url string, blocked int"))
    assert filter_urls(page, empty).first().score == pytest.approx(0.5)
    ones = fit_urls(spark.createDataFrame([("https://a.org/b", 1), ("https://a.org/b", 0)] * 3, "url string, blocked int"))
    assert filter_urls(page, ones).first().score > 0.5


def test_fits_are_reproducible(spark, model):
    again = fit_urls(labelled_urls(spark).repartition(5))
    assert np.array_equal(again.stages[1].coefficients.toArray(), model.stages[1].coefficients.toArray())
