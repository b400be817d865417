"""Secret scans: candidates in texts, and a random forest that removes false positives."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.sampling import hash_sample
from hourgrid.functions.storage import materialise
from hourgrid.llm.common import blank_words, crc_fold, small
from hourgrid.llm.labelled import MAX_LABELLED

_RUN = r"[A-Za-z0-9_+/\-]"
#: Names of credentials, as they stand before a value.
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|auth|(?:api|access|private|secret)?[_\-]?key)"
#: A candidate: a run of at least 12 of the characters of _RUN, one of them a digit, with what
#: follows it after single dots; or, of any form, a value of 4 characters or more that is assigned
#: to a name of a credential. A run is tried at its start only, so long runs take linear time.
CANDIDATE = (
    rf"(?<!{_RUN})(?=[A-Za-z_+/\-]*+[0-9]){_RUN}{{12,}}+={{0,2}}+(?:\.{_RUN}{{8,}}+)*+"
    rf"|(?<=[=:][\s\"'`]{{0,3}})(?<![^=:\s\"'`])(?<=(?i:{NAMES})[\"'`]?\s{{0,2}}[=:]{{1,2}}\s{{0,2}}[\"'`]?)[^\s\"'`,;<>()\[\]{{}}]{{4,}}+"
)
#: Frequent words of the corpus that make the dictionary, and their least length.
DICTIONARY_WORDS, WORD_CHARS = 5_000, 3
#: Buckets of neighbouring words and of path parts.
NEIGHBOURS, PATHS = 32, 8
#: Characters of a candidate whose substrings are looked up at once, and of the longest dictionary word.
PIECE, LONGEST = 256, 12

NUMBERS = ["length", "digits", "upper", "lower", "other", "turns", "case_turns", "repeats", "distinct", "hex_only", "coverage"]


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> DataFrame:
    """The ``words`` most frequent lower-case words of ASCII letters in all of ``docs`` (of
    equals the first by code points): column ``__word``. Its size bounds it."""
    word = F.explode(F.filter(F.transform(blank_words(F.col(text_col)), lambda w: F.lower(w)), lambda w: w.rlike(f"^[a-z]{{{WORD_CHARS},{LONGEST}}}$")))
    counts = docs.select(word.alias("__word")).groupBy("__word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "__word").limit(words).select("__word")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(``id_col``, ``pos``, ``candidate``, ``path``, ``before``, ``sign``, ``after``): every candidate of every
    text with its order in the text, the whole words next to it, lower-cased, and the signs
    before it. Null texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The text around candidates: piece, candidate, piece, ..., piece.
    rows = docs.select(F.col(id_col), F.col(path_col).alias("path"), F.split(text, CANDIDATE, -1).alias("__p"), F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1)).alias("__c"))
    # Backwards, patterns are tried at the piece's end only.
    last = lambda x: F.lower(F.reverse(F.regexp_extract(F.reverse(x), r"^[\s\"'`]*+[=:]*+[\s\"'`]*+([^\s\"'`=:]*+)", 1)))
    first = lambda x: F.lower(F.regexp_extract(x, r"^[\"'`]*+\s*+(\S*+)", 1))
    sign = lambda x: F.regexp_replace(F.reverse(F.regexp_extract(F.reverse(x), r"^[\s=:\"'`/@.]*+", 0)), r"\s+", "")
    item = F.transform("__c", lambda c, i: F.struct(i.cast("int").alias("pos"), c.alias("candidate"), last(F.get("__p", i)).alias("before"), sign(F.get("__p", i)).alias("sign"), first(F.get("__p", i + 1)).alias("after")))
    rows = rows.filter(F.size("__c") > 0).select(id_col, "path", F.explode(item).alias("__i"))
    return rows.select(id_col, "path", "__i.*")


def coverage(unique: DataFrame, words: DataFrame) -> DataFrame:
    """(``__cid``, ``__covered``): how many characters of each candidate (``__cid``, ``candidate``) lie in
    dictionary words.

    Candidates are cut into pieces of ``PIECE`` characters, each with what a word may reach over
    its ends, so a long one is many small rows; a piece counts its own characters only."""
    lead = LONGEST - 1
    c, start = F.col("candidate"), F.col("__start")
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(c) - 1, F.lit(0)), F.lit(PIECE))
    cut = lambda s: F.struct(s.alias("s"), F.lower(F.substring(c, F.greatest(s - lead, F.lit(0)) + 1, s + PIECE + lead - F.greatest(s - lead, F.lit(0)))).alias("t"))
    pieces = unique.select("__cid", F.explode(F.transform(starts, cut)).alias("__p")).select("__cid", F.col("__p.s").alias("__start"), F.col("__p.t").alias("__t"))
    # The pieces of one long candidate are shared out.
    tasks = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("__from", F.greatest(start - lead, F.lit(0))).repartition(tasks, "__cid", "__start")
    at = F.sequence(F.lit(1), F.greatest(F.char_length("__t") - WORD_CHARS + 1, F.lit(1)))
    windows = F.transform(at, lambda i: F.struct(F.substring("__t", i, LONGEST).alias("w"), i.alias("i")))
    parts = pieces.select("__cid", "__start", "__from", F.explode(windows).alias("s")).select("__cid", "__start", F.col("s.w").alias("__w"), (F.col("__from") + F.col("s.i") - 1).alias("__a"))
    # Words meet the places where their first letters stand; DICTIONARY_WORDS rows at most are broadcast.
    begin = F.substring("__word", 1, WORD_CHARS)
    words = F.broadcast(words.select("__word", begin.alias("__begin"), F.char_length("__word").alias("__k")))
    parts = parts.withColumn("__begin", F.substring("__w", 1, WORD_CHARS)).join(words, "__begin").filter(F.col("__w").startswith(F.col("__word")))
    own = F.sequence(F.greatest("__a", "__start"), F.least(F.col("__a") + F.col("__k"), start + PIECE) - 1)
    hit = parts.filter((F.col("__a") + F.col("__k") > start) & (F.col("__a") < start + PIECE))
    sums = hit.groupBy("__cid", "__start").agg(F.size(F.array_distinct(F.flatten(F.collect_set(own)))).alias("n"))
    return sums.groupBy("__cid").agg(F.sum("n").alias("__covered"))


def features(found: DataFrame, words: DataFrame, hide: str | None = None) -> DataFrame:
    """``found`` with the numbers ``NUMBERS`` and arrays of words ``__near`` and ``__path``.

    Strings are scored once however often they occur: distinct candidates meet the
    dictionary through their substrings. ``hide`` is a pattern of words before a candidate, for
    labels that come from those words: they and the signs stay out of ``__near``, so the
    forest can't repeat the rule."""
    c = F.col("candidate")
    n = F.char_length(c)
    share = lambda chars: F.regexp_count(c, F.lit(chars)) / n
    unique = materialise(found.select(F.md5("candidate").alias("__cid"), "candidate").dropDuplicates(["__cid"]))
    shape = unique.select(
        "__cid", n.cast("double").alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("upper"), share("[a-z]").alias("lower"), share("[^A-Za-z0-9]").alias("other"),
        (F.regexp_count(c, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")) / n).alias("turns"), (F.regexp_count(c, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / n).alias("case_turns"),
        (F.regexp_count(c, F.lit(r"(.)(?=\1)")) / n).alias("repeats"), (F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64))).alias("distinct"), c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex_only"),
    )
    shape = shape.join(coverage(unique, words), "__cid", "left").withColumn("coverage", F.coalesce(F.col("__covered") / F.col("length"), F.lit(0.0))).drop("__covered")
    out = found.withColumn("__cid", F.md5("candidate")).join(small(materialise(shape), 100_000), "__cid").drop("__cid")
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    near = [F.concat(F.lit("<"), before), F.concat(F.lit("="), F.coalesce("sign", F.lit(""))), F.concat(F.lit(">"), after)]
    if hide is not None:
        near = [F.concat(F.lit("<"), F.when(~before.rlike(hide), before).otherwise(F.lit(""))), near[2]]
    return out.withColumns({"__near": F.array(*near), "__path": F.filter(F.split(F.coalesce("path", F.lit("")), r"[/\\.:?#]+"), lambda p: p != "")})


def fit_false_positive_filter(featured: DataFrame, label_col: str = "label", id_col: str = "doc_id", trees: int = 20, depth: int = 6, max_labelled: int = MAX_LABELLED, seed: int = 7) -> PipelineModel | None:
    """A random forest on labelled findings: rows of :func:`features` with ``label_col`` 0 or 1.

    At most ``max_labelled`` labelled rows, chosen by hash, are used; ids that are held out
    (crc32 modulo 5 is 0) and rows without label are not. None without both classes."""
    rows = featured.filter(F.col(label_col).isNotNull() & (crc_fold(F.col(id_col)) != 0)).withColumn("__y", F.col(label_col).cast("double"))
    rows = rows.select(F.md5("candidate").alias("__cid"), F.col(id_col).alias("__id"), "pos", *NUMBERS, "__near", "__path", "__y")
    rows = materialise(hash_sample(rows, max_labelled, ["__cid", "__id", "pos"]))
    if rows.select("__y").distinct().count() < 2:
        return None
    steps = [HashingTF(numFeatures=NEIGHBOURS, inputCol="__near", outputCol="__nearv"), HashingTF(numFeatures=PATHS, inputCol="__path", outputCol="__pathv"), VectorAssembler(inputCols=[*NUMBERS, "__nearv", "__pathv"], outputCol="__x")]
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed, rawPredictionCol="__raw", probabilityCol="__prob", predictionCol="__pred")
    return Pipeline(stages=[*steps, forest]).fit(rows)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, label: Column | None = None, hide: str | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Candidates with ``score`` (double, 0 to 1: likelier a secret) and ``is_secret`` (score >= 0.5).

    Labels come from ``findings`` (``id_col``, pos, label 0/1), or from ``label``, an
    expression over the columns of :func:`candidates`; ``hide`` (see :func:`features`) keeps what
    such a rule reads from the forest. A candidate that occurs in many documents is
    featurised once; neither texts nor candidates of a document are gathered in one row.
    Without labels of both classes every score is 0.5.

    Returns (``id_col``, ``pos``, ``candidate``, ``path``, ``before``, ``after``, ``label``, ``score``,
    ``is_secret``). Defined cases: null and empty texts have no candidates; null paths and
    missing neighbours are empty words; very long texts, candidates and neighbours are
    taken whole, in linear time; repeated rows give repeated candidates; an empty table
    gives an empty table; columns not named here are not read, whatever their names.
    """
    found = candidates(docs, id_col, text_col, path_col)
    if findings is not None:
        found = found.join(findings.select(id_col, "pos", "label"), [id_col, "pos"], "left")
    else:
        found = found.withColumn("label", F.lit(None).cast("int") if label is None else label)
    found = materialise(found)
    featured = features(found, materialise(dictionary(docs, text_col)), hide)
    model = fit_false_positive_filter(featured, "label", id_col)
    if model is None:
        scored = featured.withColumn("score", F.lit(0.5))
    else:
        scored = model.transform(featured).withColumn("score", vector_to_array("__prob")[1])
    return scored.select(id_col, "pos", "candidate", "path", "before", "after", "label", "score", (F.col("score") >= 0.5).alias("is_secret"))
