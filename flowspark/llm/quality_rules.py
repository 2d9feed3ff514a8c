"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text.

Words and pairs of words are hashed to buckets, about twice the square root of the texts' bytes of them:
what is gathered of the corpus grows with it, and so slowly that the table of ratios fits every task
(4 bytes a bucket; 2 MB at 30 GB of text, at most ``2**MOST_BITS`` buckets).  Two multinomials over the buckets are
counted: that of the raw corpus over all documents, and that of trusted text over all documents with
label ``quality = 1`` of one half (by the text's hash).  A document's score is the mean over its
n-grams of the log of the ratio of the two.  The threshold follows from all labelled documents of the
other half: the score that parts its good and bad documents with the best balanced accuracy.
Documents under the base rules' limits are rejected whatever their score.

The counts of a bucket are summed before and after the shuffle; a task holds two numbers for each
bucket, whatever it reads.  Labels meet the texts of the one half and the scores of the other by
joins on the id; the threshold comes from running sums over slices of scores.

Defined results: a null or empty text has no words and is rejected by the base rules; with no trusted
or no bad label every score passes; rows repeated are counted as often as they stand there; an id
with several labels counts as good only if all say so; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.ordering import running_sum

from .common import by_bytes, map_rows, pick, sample_ids, stored

#: Log2 of the number of buckets, at least and at most.
BITS, MOST_BITS = 14, 26
#: Count that is added to each bucket.
SMOOTHING = 0.5
#: Words of a window that is looked up in the rest of its text.
WINDOW = 8
FEWEST_WORDS, MOST_REPEATED_PERCENT = 20, 30
#: Words whose hash a task keeps.
CACHE = 300_000

_SYMBOL = re.compile(r"[#*$%&|<>]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Buckets of the words and word pairs of a text."""

    def __init__(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.known: dict[bytes, int] = {}

    def buckets(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        one = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = zlib.crc32(w) + 1
                if len(w) <= 32:
                    known[w] = h
            one[i] = h
        with np.errstate(over="ignore"):
            mixed = one * _ODD
            mixed ^= mixed >> np.uint64(32)
            two = (mixed[:-1] * np.uint64(31) + mixed[1:]) * _ODD
            return np.concatenate([(mixed * _ODD) >> self.shift, (two ^ (two << np.uint64(17))) * _ODD >> self.shift]).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which the text has at least twice.

    Windows are numbered exactly: those of two, four and eight words by the numbers of their halves.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    width = 1
    while width < window:
        left, right = number[:-width], number[width:]
        _, number = np.unique(left * (n + 1) + right, return_inverse=True)
        width *= 2
    again = np.flatnonzero(np.bincount(number)[number] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_of(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not words:
        return 0, 0, 0 if not text else len(_SYMBOL.findall(text)), 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return len(words), chars, len(_SYMBOL.findall(text)), dup, repeated_words(words)


def bucket_bits(text_bytes: int) -> int:
    """Log2 of the number of buckets for so many bytes of text."""
    return min(MOST_BITS, max(BITS, math.ceil(math.log2(max(1, text_bytes)) / 2) + 1))


def bucket_counts(docs: DataFrame, bits: int) -> np.ndarray:
    """How often each bucket stands in the n-grams of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(bits), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for some in by_bytes(batch, "text"):
                found = [hasher.buckets(words) for text in some.column("text").to_pylist() if (words := words_of(text))]
                if found:
                    total += np.bincount(np.concatenate(found), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(1 << bits, np.int64)
    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the ratio of the two smoothed multinomials, for each bucket."""
    p = (trusted + SMOOTHING) / (trusted.sum() + SMOOTHING * len(trusted))
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    return np.log(p / q).astype(np.float32)


def measured(docs: DataFrame, weights: np.ndarray, bits: int) -> DataFrame:
    """``docs`` (text, ...) with the base columns and ``score`` in the text's place."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def start():
        hasher = Hasher(bits)

        def work(rows: dict[str, list]) -> dict[str, list]:
            base, scores = [], []
            for text in rows["text"]:
                words = words_of(text)
                base.append(base_of(text, words))
                scores.append(float(sent.value[hasher.buckets(words)].mean(dtype=np.float64)) if words else None)
            return {c: rows[c] for c in kept} | {n: [b[i] for b in base] for i, n in enumerate(names)} | {"score": scores}

        return work

    of_kept = "".join(f"{c} {kind}, " for c, kind in docs.dtypes if c != "text")
    return map_rows(docs, of_kept + ", ".join(f"{n} long" for n in names) + ", score double", start)


def best_threshold(scores: DataFrame) -> float:
    """Of (quality, score): the score that parts good (1) and bad (0) with the best balanced accuracy, halfway
    to the next score; a tie goes to the lower one, which keeps more.

    Cuts are compared by whole numbers: bad rows below times all good ones, less good rows below times all bad ones.
    """
    is_good, is_bad = (F.count_if(F.col("quality") == q).alias(n) for q, n in ((1, "good"), (0, "bad")))
    each = stored(scores.filter("score is not null and quality in (0, 1)").groupBy("score").agg(is_good, is_bad), "quality-cuts")
    good, bad = each.agg(F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return -np.inf
    sliced = each.select("score", (F.col("bad") * good - F.col("good") * bad).alias("gain")).repartitionByRange("score").withColumn("_slice", F.spark_partition_id())
    summed = stored(running_sum(stored(sliced, "quality-slices"), "gain", "upto", (), "_slice", ("score",)), "quality-sums")
    cut, gain = summed.orderBy(F.desc("upto"), "score").select("score", "upto").first()
    if gain <= 0:
        return -np.inf
    return (cut + summed.filter(F.col("score") > cut).agg(F.min("score")).first()[0]) / 2


def bounded(rows: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(text, quality) of at most ``most`` labelled rows, chosen by hashes; rows alike in id and text are one."""
    # At most `most` rows of two numbers: small enough to send to every task.
    met = rows.join(F.broadcast(sample_ids(known, most).withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    # One id may stand on many rows: they are bounded too.  Only two numbers of each pass through the one task
    # that counts them off.
    met = stored(met.select(F.xxhash64("doc_id", "text").alias("_key"), "text", "quality").dropDuplicates(["_key", "quality"]), "quality-labelled")
    kept = met.select("_key", "quality").orderBy("_key", "quality").limit(most)
    return stored(met.join(F.broadcast(kept), ["_key", "quality"]).select("text", "quality"), "quality-sample")


def judge(docs: DataFrame, labels: DataFrame, most: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)
    for every document.

    All labelled documents count; a caller may bound them by ``most``, for a quicker look.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    bits = bucket_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    known = pick(labels, doc_id="doc_id", quality="quality").filter("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0  # copies go to the same part
    # By hint, or a table of labels that is just small enough would be sent to every task.
    labelled = rows.join(known.hint("merge"), "doc_id") if most is None else bounded(rows, known, most)
    raw = bucket_counts(rows, bits)
    trusted = bucket_counts(labelled.filter(half & (F.col("quality") == 1)), bits)
    weights = log_ratio(trusted, raw) if trusted.any() else np.zeros(1 << bits, np.float32)
    scored = stored(measured(rows.withColumn("_half", half), weights, bits), "quality-scores")
    limit = -np.inf
    if trusted.any():
        limit = best_threshold(scored.filter("not _half").join(known, "doc_id") if most is None else measured(labelled.filter(~half), weights, bits))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return (
        scored.drop("_half")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("score"), F.lit(0.0)) >= F.lit(limit)))
    )
