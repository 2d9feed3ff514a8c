"""Secret scans: candidates from patterns, false positives removed by a random forest.

A candidate is a run of at least ``SHORTEST`` characters of keys and tokens with a digit in it, or of
at least ``ANNOUNCED`` of them, with or without a digit, right after a key word with an assignment
sign or "is"; a run of a known issuer's form, with or without a digit; or what stands in a URL between a name and
``@``.  ``=`` belongs to a candidate only as padding at its end, so a name and its sign stand before it.
Parts of e-mail addresses are no candidates.

Features of the value: length, shares of character classes, changes of class, different characters, the
mean log-probability of its character transitions in the corpus' words, coverage by dictionary words,
marks of a path.  Features of its neighbours: a key word, an assignment sign or a quote before it.  The
dictionary is the ``DICTIONARY`` most frequent words of the corpus; transitions are counted over all of
its words.

The forest learns from labelled findings.  Where none are given, two views teach each other: what stands
before a value labels it (assigned to a key word, or elsewhere so, or of a known issuer's form
``ISSUED``: a secret; else none), and a forest that sees the value alone learns from that; the findings
of which it is sure then teach the forest over all features.  At most ``SAMPLE`` findings (by a hash of
the value) are learned from.

Everything is column expressions, joins and ``pyspark.ml``.

Defined results: null and empty texts have no findings; each occurrence is a finding, repeated rows
included; with labels of one kind only, or none, the label alone decides; an empty table gives an empty
result.  Values are not returned, only their hash.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored
from .spans_sql import let, matches

SHORTEST, ANNOUNCED, SHORT_IN_URL = 16, 6, 4
SAMPLE = 20_000
DICTIONARY = 1_000
#: Code points before a candidate that are its neighbouring words.
NEIGHBOURS = 32
#: Probability from which a candidate is reported as a secret.
SECRET = 0.5

# Characters of keys and tokens, and words that announce one.
_NAMES = r"token|secret|passw|pwd|api_?key|access_?key|private_?key|credential|auth|bearer"
_CHARACTERS = "[A-Za-z0-9_+/.-]"
_AFTER_SIGN = r"(?<=[=:][\x20\t]{0,3}[\"'`]?)"
#: A value after a key word, the rest of its name, and a sign: what stands before it is of bounded length.
_AFTER_NAME = r"(?<=(?i:token|secret|passw|password|passwd|passphrase|pwd|api_?key|access_?key|private_?key|credential|auth_?key)(?i:[a-z0-9_]{0,16})[\"'`]?[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"'`]?)"
#: "... password is", the part of a URL between a name and its host, and what issuers' keys look like.
_AFTER_IS = r"(?<=is\x20)(?<=(?i:token|secret|password|passwd|passphrase|pwd|credential)\x20(?i:is)\x20)"
_IN_URL = r"(?<=:)(?<=://[A-Za-z0-9_.%+-]{0,64}:)"
_ISSUED = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
CANDIDATE = (
    # The sign is looked for first: few runs have one before them.
    rf"(?<!{_CHARACTERS}){_AFTER_SIGN}{_AFTER_NAME}{_CHARACTERS}{{{ANNOUNCED},}}+(?!@)={{0,2}}"
    rf"|(?<!{_CHARACTERS}){_AFTER_IS}{_CHARACTERS}{{{ANNOUNCED},}}+(?!@)={{0,2}}"
    rf"|{_IN_URL}[^\x20\t\n\r/@:]{{{SHORT_IN_URL},}}+(?=@)"
    rf"|(?<!{_CHARACTERS})(?:{_ISSUED})(?!{_CHARACTERS})={{0,2}}"
    rf"|(?<!{_CHARACTERS})(?<!@)(?=[A-Za-z_+/.-]*+[0-9]){_CHARACTERS}{{{SHORTEST},}}+(?!@)={{0,2}}"
)
KEYWORD = rf"(?i)({_NAMES})"
IN_URL = r"://[^\x20/@]*:$"
#: Forms that issuers give their keys.
ISSUED = rf"^({_ISSUED})=*$"
VALUE = ("length", "digits", "upper", "lower", "changes", "different", "transitions", "coverage", "path_marks")
FEATURES = (*VALUE, "keyword", "assigned", "quoted")
#: Kinds of characters between which transitions are counted: 26 letters, digits, others.
KINDS = 28
#: From here, and to here, the forest over values is sure.
SURE, SURELY_NOT = 0.8, 0.2


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) of the words of three to twelve ASCII letters over all texts; stored."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])[a-z]{3,12}+(?![a-z])"), F.lit(0))).alias("word"))
    return stored(words.groupBy("word").count(), "words")


def dictionary(counts: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The most frequent words; ties by the word."""
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(most).collect()]


def steps(text: Column) -> Column:
    """The transitions between neighbouring characters of a text, as numbers below ``KINDS**2``."""
    code = lambda c: F.ascii(c)
    kind = lambda c: F.when(code(c).between(97, 122), code(c) - 97).when(code(c).between(48, 57), 26).otherwise(27)
    kinds = F.transform(F.split(F.lower(text), ""), kind)
    return let(kinds, lambda k: F.zip_with(F.slice(k, F.lit(1), F.greatest(F.size(k) - 1, F.lit(0))), F.slice(k, F.lit(2), F.greatest(F.size(k) - 1, F.lit(0))), lambda a, b: a * KINDS + b))


def transition_weights(counts: DataFrame) -> list[float]:
    """Log-probability of each transition, given the character before it; one is added to every count."""
    each = counts.select("count", F.explode(steps(F.col("word"))).alias("step")).groupBy("step").agg(F.sum("count").alias("n"))
    seen = {r["step"]: r["n"] for r in each.collect()}  # at most KINDS**2
    table = [[1 + seen.get(i * KINDS + j, 0) for j in range(KINDS)] for i in range(KINDS)]
    return [math.log(n / sum(row)) for row in table for n in row]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, before, sign, value) of every candidate in ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    each = rows.filter(F.size("found") > 0).select("doc_id", F.explode(matches(F.col("text"), F.col("found"), CANDIDATE)).alias("m"))
    return each.select("doc_id", "m.start", "m.end", F.lower(F.right(F.col("m.before"), F.lit(NEIGHBOURS))).alias("before"), F.right(F.col("m.before"), F.lit(4)).alias("sign"), "m.value")


def with_features(rows: DataFrame, words: list[str], weights: list[float]) -> DataFrame:
    value, size = F.col("value"), F.char_length("value").cast("double")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / size
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    table = F.array(*[F.lit(w) for w in weights])
    letters = F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), F.lit(0))
    covered: Column = F.aggregate(F.filter(letters, lambda w: F.array_contains(known, w)), F.lit(0), lambda a, w: a + F.char_length(w))
    likely = F.aggregate(steps(value), F.lit(0.0), lambda a, i: a + F.get(table, i))
    edge = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    return rows.withColumns(
        {
            "length": F.log(size),
            "digits": share("[0-9]"),
            "upper": share("[A-Z]"),
            "lower": share("[a-z]"),
            "changes": share(edge),
            "different": F.size(F.array_distinct(F.split(value, ""))) / size,
            "transitions": F.coalesce(likely / F.greatest(F.lit(1.0), size - 1), F.lit(0.0)),
            "coverage": covered / size,
            "path_marks": share("[/.]"),
            "keyword": (F.col("before").rlike(KEYWORD) | F.col("before").rlike(IN_URL)).cast("double"),
            "assigned": (F.col("sign").rlike("[=:]") | F.col("sign").rlike(r"\bis\x20$")).cast("double"),
            "quoted": F.col("sign").rlike("[\"'`]").cast("double"),
        }
    )


def label_by_neighbours(rows: DataFrame) -> DataFrame:
    """Add ``label`` by what stands before a value, here or elsewhere; numbers alone are no secrets."""
    announced = (F.col("keyword") == 1.0) & (F.col("assigned") == 1.0) & (F.col("digits") < 1.0)
    known = rows.filter(announced).select(F.col("value").alias("_value")).distinct()
    again = rows.join(known, F.col("value") == F.col("_value"), "left")
    return again.withColumn("label", (F.col("_value").isNotNull() | F.col("value").rlike(ISSUED)).cast("double")).drop("_value")


def forest(judged: DataFrame, features: tuple[str, ...], most: int, trees: int, depth: int, seed: int):
    """A forest over a sample of ``judged`` (value, before, label, features), or None with labels of one
    kind.  One order of the sample gives the same forest on every run."""
    sample = judged.filter("label is not null").select(*features, F.col("label").cast("double").alias("label"), F.xxhash64("value", "before").alias("_h"))
    sample = stored(sample.orderBy("_h", *features, "label").limit(most), "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(sample.repartition(1).sortWithinPartitions("_h", *features, "label"))
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scored_by(model, rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None, most: int = SAMPLE, trees: int = 20, depth: int = 5, seed: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, value_sha256, score, is_secret) of every candidate.

    ``labelled``: (before, sign, value, label) of judged findings, instead of the two views.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    counts = word_counts(rows)
    words, weights = dictionary(counts), transition_weights(counts)
    found = stored(with_features(candidates(rows), words, weights), "secret-candidates")
    learn = lambda judged, features: forest(judged, features, most, trees, depth, seed)
    if labelled is not None:
        model = learn(with_features(labelled, words, weights), FEATURES)
        scored = scored_by(model, found, FEATURES) if model else found.withColumn("score", F.lit(0.0))
    else:
        judged = label_by_neighbours(found)
        by_value = learn(judged, VALUE)
        if by_value is None:
            scored = judged.withColumn("score", F.col("label"))
        else:
            sure = scored_by(by_value, judged, VALUE)
            taught = F.when((F.col("score") >= SURE) | (F.col("label") == 1.0), 1.0).when(F.col("score") <= SURELY_NOT, 0.0)
            model = learn(sure.withColumn("label", taught), FEATURES)
            scored = scored_by(model or by_value, found, FEATURES if model else VALUE)
    return scored.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= SECRET).alias("is_secret"))
