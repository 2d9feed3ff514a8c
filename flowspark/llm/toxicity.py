"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows train three things, all on a sample of at most ``most`` rows (a hash of the id picks
them): the lexicon, the trees and the calibration.  The lexicon is a short fixed list of insults and
the words whose share of toxic texts is well above their share of others.  Features of a text are
densities of lexicon words, their distance from second-person words, capitals, punctuation, and
lexicon words behind look-alike characters, separators or stretched letters.  Trees and lexicon use
three quarters of the sample, calibration the rest.

Defined results: null and empty texts have all features 0 and get the score of such a text; equal
texts get equal scores, on every run and whatever the partitions; without labels, or with labels of one kind only, every score is the share of
toxic labels (0 without any); an id with several labels is toxic if any of them says so; a null label
is no label; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import by_bytes, map_rows, pick, sample_ids, stored, text_key

#: Labelled rows that training reads at most.
SAMPLE = 20_000
#: Words of the learned lexicon at most, and the least lower bound of their log-odds.
LEXICON, LEAST_ODDS = 400, 1.0
#: Rows of the common share that each step of the calibration is mixed with.
PRIOR = 2
#: Words between a lexicon word and a second-person word that count as near.
NEAR = 3
#: Score from which a text is predicted toxic.
TOXIC = 0.3

# Mild insults, second-person words of four languages, characters that stand for letters.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash pathetic worthless disgusting fool imbecile idiota estúpido basura idiote stupide dummkopf".split())
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti vosotros vuestro".split())
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

#: The features' columns; the mark in front keeps them apart from a table's own.
FEATURES = tuple(
    f"__{name}"
    for name in "lexicon_density lexicon_count lexicon_kinds fixed_count near_second second_density capitals shouted punctuation exclamations hidden_density hidden_lexicon log_words word_length".split()
)
_SPACED = str.maketrans(dict.fromkeys(string.punctuation + "«»“”„…¡¿", " "))
_HIDDEN = re.compile(r"(?<!\S)\S*[^\W\d_](?:[0-9@$!|*._-]+)[^\W\d_]\S*")
_LETTERS = re.compile(r"(?<!\w)(?:[^\W\d_][ ._-]){3,}[^\W\d_](?!\w)")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_UPPER = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ]{3,}(?!\w)")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARK = re.compile(r"[!-/:-@\[-`{-~]")


def features(text: str | None, lexicon: frozenset[str]) -> list[float]:
    if not text or not (words := text.lower().translate(_SPACED).split()):
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    present = set(words)
    found, second = present & lexicon, present & SECOND
    hits = near = fixed = seconds = 0
    if found or second:
        at_hits = [i for i, w in enumerate(words) if w in found]
        at_second = [i for i, w in enumerate(words) if w in second]
        hits, seconds = len(at_hits), len(at_second)
        fixed = sum(words[i] in INSULTS for i in at_hits)
        places = set(at_second)
        near = sum(any(j in places for j in range(i - NEAR, i + NEAR + 1)) for i in at_hits)
    hidden = [m[0] for m in _HIDDEN.finditer(text)]
    plain = {re.sub(r"[\W\d_]", "", h.lower().translate(LOOKALIKE)) for h in hidden}
    plain |= {re.sub(r"[\W\d_]", "", m[0].lower()) for m in _LETTERS.finditer(text)}
    if _STRETCHED.search(text):
        plain |= {_STRETCHED.sub(r"\1", w) for w in present if _STRETCHED.search(w)}
    return [
        hits / n,
        math.log1p(hits),
        float(len(found)),
        math.log1p(fixed),
        near / hits if hits else 0.0,
        seconds / n,
        len(_CAPITAL.findall(text)) / chars,
        len(_UPPER.findall(text)) / n,
        len(_MARK.findall(text)) / chars,
        text.count("!") / n,
        len(hidden) / n,
        math.log1p(len((plain - present) & lexicon)),
        math.log1p(n),
        sum(map(len, words)) / n,
    ]


def with_features(rows: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """``rows`` (text, ...) with the feature columns; no row is joined or moved."""
    schema = StructType([*rows.schema.fields, *[StructField(f, DoubleType()) for f in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, "text"):
                found = np.array([features(t, lexicon) for t in some.column("text").to_pylist()]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(c) for c in found.T]], names=[*some.schema.names, *FEATURES])

    return rows.mapInArrow(run, schema)


def sketch(words: list[str], seeds: int = 3, width: int = 5) -> list[int]:
    """Min-hashes of the five-word shingles: near copies agree in most of them."""
    shingles = {" ".join(words[i : i + width]).encode() for i in range(max(1, len(words) - width + 1))}
    return [min(xxhash.xxh64_intdigest(x, seed) for x in shingles) >> 1 for seed in range(seeds)]


def learn_lexicon(rows: DataFrame) -> frozenset[str]:
    """Words whose log-odds of standing in a toxic text are surely above ``LEAST_ODDS``, the
    strongest ``LEXICON`` of them, and the fixed insults.  ``rows``: (text, toxic).

    A word counts the different texts it stands in.  Copies and near copies agree in a min-hash and
    count as one text, so the words of a much copied text are no evidence.
    """

    def start():
        def work(part: dict[str, list]) -> dict[str, list]:
            found = []
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                words = (text or "").lower().translate(_SPACED).split()
                found += [(w, toxic, *like) for like in [sketch(words)] for w in set(words)]
            return {name: [f[i] for f in found] for i, name in enumerate(("word", "toxic", "h0", "h1", "h2"))}

        return work

    words = map_rows(rows.select("text", "toxic"), "word string, toxic int, h0 long, h1 long, h2 long", start)
    each = words.select("word", "toxic", F.posexplode(F.array("h0", "h1", "h2")).alias("k", "like")).distinct()
    texts = each.groupBy("word", "k").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c")).groupBy("word").agg(F.min("a").alias("a"), F.min("c").alias("c"))
    total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("a"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("c")).first()
    a, c = F.col("a"), F.col("c")
    odds = F.log((a + 0.5) / F.lit(total["a"] + 1.0)) - F.log((c + 0.5) / F.lit(total["c"] + 1.0)) - 1.96 * F.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
    least = max(3, total["a"] // 200)
    best = texts.filter((a >= least) & (F.length("word") >= 3)).select("word", odds.alias("odds")).filter(F.col("odds") > LEAST_ODDS).orderBy(F.desc("odds"), "word").limit(LEXICON)
    return INSULTS | {r["word"] for r in best.collect()}


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return remainder(doc_id) == 2


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


class Model:
    """A trained scorer: ``score`` of a frame of feature columns."""

    def __init__(self, lexicon: frozenset[str], trees, calibration, constant: float) -> None:
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` (text, ...) with ``__score``."""
        if self.trees is None:
            return rows.withColumn("__score", F.lit(self.constant))
        scored = raw_score(self.trees, with_features(rows, self.lexicon)).drop(*FEATURES)
        if self.calibration is not None:
            scored = self.calibration.transform(scored).drop("__raw").withColumnRenamed("__calibrated", "__raw")
        return scored.withColumn("__score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__raw")))).drop("__raw")


def raw_score(trees, rows: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(rows)
    return trees.transform(vectors).withColumn("__raw", vector_to_array("__probability")[1]).drop("__features", "__margins", "__probability", "__class")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, trees: int = 20, depth: int = 4, seed: int = 5) -> Model:
    """Learn from at most ``most`` labelled rows, never from those of :func:`held_out`."""
    known = pick(labels, doc_id="doc_id", toxic="toxic").filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = sample_ids(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), most)
    # At most `most` rows of two numbers: small enough to send to every task.
    rows = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    # Copies would weigh as often as they stand there: of each text, the row of the smallest id stays.
    rows = rows.groupBy(text_key().alias("_key"), "toxic").agg(F.min(F.struct("doc_id", "text"))["text"].alias("text"))
    # One id may stand on many different texts: the texts are bounded too, by their own hash.  Only two numbers
    # of each pass through the one task that counts them off.
    rows = stored(rows, "toxicity-labelled")
    kept = rows.select("_key", "toxic").orderBy(F.xxhash64("_key"), "_key", "toxic").limit(most)
    rows = stored(rows.join(F.broadcast(kept), ["_key", "toxic"]), "toxicity-sample")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("a")).first()
    share = counts["a"] / counts["n"] if counts["n"] else 0.0
    fitting = F.pmod(F.col("_key"), F.lit(4)) != 0
    fit_on = rows.filter(fitting)
    if fit_on.select("toxic").distinct().count() < 2:
        return Model(INSULTS, None, None, share)
    lexicon = learn_lexicon(fit_on)
    table = stored(with_features(rows, lexicon).withColumn("_fit", fitting).drop("text"), "toxicity-features")
    # One order of the sample, whatever the partitions were: sums and splits come out alike.
    ordered = table.filter("_fit").repartition(1).sortWithinPartitions("_key", "toxic")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(ordered)
    least = max(4, counts["n"] // 800)
    boosted = GBTClassifier(featuresCol="__features", labelCol="toxic", predictionCol="__class", maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=1.0, minInstancesPerNode=least, seed=seed, checkpointInterval=-1)
    model = boosted.setProbabilityCol("__probability").setRawPredictionCol("__margins").fit(vectors)
    # Steps of the raw score, each drawn to the common share as by PRIOR rows: a handful of rows with
    # a wrong label does not make a step of its own.
    step = F.round(F.col("__raw") * 50) / 50
    steps = raw_score(model, table.filter(~F.col("_fit"))).groupBy(step.alias("__raw")).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("a"))
    check = steps.select("__raw", ((F.col("a") + PRIOR * share) / (F.col("n") + PRIOR)).alias("toxic"), (F.col("n") + F.lit(float(PRIOR))).alias("weight"))
    calibration = None
    if not check.isEmpty():
        calibration = IsotonicRegression(featuresCol="__raw", labelCol="toxic", weightCol="weight", predictionCol="__calibrated").fit(check.coalesce(1))
    return Model(lexicon, model, calibration, share)


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    rows = pick(docs, doc_id=doc_id, text=text)
    scored = train(rows, labels, most).apply(rows)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= TOXIC).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that are not predicted toxic, each judged by its own text."""
    return train(pick(docs, doc_id="doc_id", text="text"), labels, most).apply(docs).filter(F.col("__score") < TOXIC).select(*docs.columns)
