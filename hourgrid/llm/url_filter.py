"""URL filters: rules by host and path, and a classifier of URLs that no rule fits.

The classifier is a logistic regression on hashed character n-grams of host and path.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.sampling import hash_sample
from hourgrid.llm.common import LOWER, UPPER

#: Rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Buckets of the n-gram hash, and the lengths of n-grams.
BUCKETS, LENGTHS = 1 << 18, (3, 4, 5)
#: Ridge penalty of the regression.
PENALTY = 1e-2
#: Rules of a policy at most.
MAX_RULES = 500
#: Labelled URLs that a model is fitted on at most, chosen by a hash of the URL.
MAX_LABELLED = 50_000

#: The words of a small labelled table of URLs: names of sites that a corpus leaves out, and of ordinary ones.
BLOCKED = (
    "casino", "poker", "slots", "jackpot", "roulette", "bets", "betting", "sportsbet", "lottery", "bingo", "adult", "porn", "sexy", "nude", "escort", "xxx", "camgirls", "hookup",
    "viagra", "pills", "meds", "pharmacy", "dietpills", "steroids", "replica", "spam", "linkfarm", "backlinks", "seo", "followers", "clickbait", "click-farm",
    "warez", "crack", "keygen", "torrent", "malware", "phishing", "ads", "adserver", "adtrack", "banner", "popup", "tracker", "tracking", "affiliate", "payday", "loans", "prize", "giveaway",
)
ALLOWED = (
    "news", "dailynews", "herald", "journal", "library", "university", "college", "physics", "science", "nature", "biology", "history", "museum", "archive", "encyclopedia", "weather", "travel", "hiking",
    "recipes", "kitchen", "garden", "health", "hospital", "medicine", "parliament", "cityhall", "transport", "railways", "timetables", "football", "chess", "music", "orchestra", "theatre", "film", "poetry",
    "bookshop", "publisher", "translation", "linguistics", "dictionary", "python", "opensource", "database", "statistics", "mathematics", "astronomy", "engineering", "bridges", "architecture", "photography", "painting",
    "zeitung", "bibliothek", "wissenschaft", "geschichte", "stadtwerke", "lesoir", "recettes", "universite", "noticias", "cultura", "ciencia", "historia", "lion", "northshire", "anderson", "winterhaven", "address",
    "freedom", "betterworld", "athletics", "farmersmarket", "pillow", "clinic", "winery", "thornton", "shire", "stone", "reading", "estate", "heather", "ingleside", "edwards", "tanner", "ledger", "thistle", "interest",
)
#: How a site's name is made of a word, and where such sites are; both kinds of words go through all in turn.
_NAMES = ("{}", "{}-{f}", "{f}-{}", "{}{f}")
_FILLERS = ("online", "best", "hub", "top", "my", "world", "shop", "24", "city", "club", "pro")
_PREFIXES, _ZONES = ("", "www.", "blog.", "m.", ""), ("org", "net", "com", "example.org", "example.net", "example.com", "info")
_PATHS = ("/en/10482", "/de/2291.html", "/fr/771/", "/es/31337?page=2", "/en/553#top", "/", "/2021/05/title.html", "/index.html", "/en/88?utm_source=feed")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): the built-in table, four URLs for each word. Words of both kinds get the same prefixes,
    fillers, zones and paths in turn (their numbers have no common divisor), so a model learns nothing from these."""
    rows = []
    for words, y in ((BLOCKED, 1), (ALLOWED, 0)):
        at = lambda parts: parts[len(rows) % len(parts)]  # noqa: B023, E731
        for word in words:
            for name in _NAMES:
                rows.append((f"https://{at(_PREFIXES)}{name.format(word, f=at(_FILLERS))}.{at(_ZONES)}{at(_PATHS)}", y))
    return spark.createDataFrame(rows, "url string, blocked int")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``,
    ``#`` or the end. Null, or a URL without ``://``, has both empty."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    # Line breaks are characters like others: (?s).
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def with_ngrams(df: DataFrame, host: Column, path: Column, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Adds ``__grams``, the character n-grams of host and path, each with its field and its ends marked; digits
    count as one sign. Characters are split into a column first, so a long URL takes linear time."""
    marked = lambda part: F.split(F.concat(F.lit("^"), F.translate(F.lower(part), "123456789", "0" * 9), F.lit("$")), "", -1)
    df = df.withColumns({"__hc": marked(host), "__pc": marked(path)})

    def grams(name: str, n: int) -> Column:
        last = F.size(f"__{name}c") - n
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(F.lit(name), *[F.get(f"__{name}c", i + j) for j in range(n)]))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<string>"))

    return df.withColumn("__grams", F.concat(*[grams(name, n) for name in ("h", "p") for n in lengths])).drop("__hc", "__pc")


def fit_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", penalty: float = PENALTY, max_rows: int = MAX_LABELLED) -> PipelineModel:
    """A ridge logistic regression on hashed n-grams of the labelled URLs, ``max_rows`` at most (by
    a hash of the URL). Nulls are no labels; an URL with several labels has the largest. Half an
    empty URL of either label is added, so a table without both labels, or an empty one, gives a
    smoothed rate."""
    rows = labelled.filter(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(url_col).alias("__url")).agg(F.max(label_col).cast("double").alias("__y"))
    rows = hash_sample(rows, max_rows, ["__url"])
    rows = with_ngrams(rows, *url_parts(F.col("__url"))).select("__grams", "__y", F.lit(1.0).alias("__w"))
    halves = rows.sparkSession.createDataFrame([([], 0.0, 0.5), ([], 1.0, 0.5)], "__grams array<string>, __y double, __w double")
    grams = HashingTF(inputCol="__grams", outputCol="__x", numFeatures=BUCKETS, binary=True)
    fit = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__predicted", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=200)
    # One partition in one order: sums, and so weights, are the same in every run.
    return Pipeline(stages=[grams, fit]).fit(rows.unionByName(halves).coalesce(1).sortWithinPartitions("__grams"))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. A rule fits its host and all
    subdomains if the path starts with the rule's. Rules are constants of a policy, so they are part of
    the expression."""
    if len({h + p for _, h, p in rules}) < len(rules) or len(rules) > MAX_RULES:
        raise ValueError(f"rules must differ in host and path, and be {MAX_RULES} at most")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, model: PipelineModel, rules: tuple[tuple[str, str, str], ...] = RULES, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Judges every URL: by the longest rule that fits, else by the model.

    Returns all columns of ``pages`` and, added or replaced: ``host`` and ``path`` (see
    :func:`url_parts`), ``rule`` (host and path of the rule, or null), ``score`` (the model's
    probability that the URL is to be blocked) and ``verdict`` (allow or block). One pass,
    no shuffle; the model's weights, 2 MB, go with the tasks.

    Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is
    judged by the model as an empty URL; an URL without path fits no rule that asks for one;
    repeated rows stay and get equal results; very long URLs are read as a whole in linear
    time; an empty table gives an empty table; columns that begin with two underscores are not for callers.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.withColumns({"__host": host, "__path": path})
    rows = model.transform(with_ngrams(rows, F.col("__host"), F.col("__path")))
    rule, said = fitting_rule(F.col("__host"), F.col("__path"), rules)
    score = vector_to_array("__probability")[1]
    made = {"host": F.col("__host"), "path": F.col("__path"), "rule": rule, "score": score, "verdict": F.coalesce(said, F.when(score >= threshold, "block").otherwise("allow"))}
    return rows.select(*[c for c in pages.columns if c not in made], *[v.alias(c) for c, v in made.items()])
