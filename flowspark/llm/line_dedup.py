"""Line dedup: drop lines that many documents share, wherever they stand but in one document.

Lines are exploded, normalised and hashed; distinct documents are counted for each hash; lines whose
hash is in enough documents go, but for those of the document with the largest id; what is left is
put together by position.

A document is a ``doc_id``; rows that share an id are one document in the counts (a missing id is an
id too, and the smallest), but each row keeps its own text.  Null and empty texts are one empty line.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key

#: The characters stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5


def key_of(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2): the lines long enough to be looked at, hashed to 128 bits.

    The two hashes start from different seeds, so they don't collide together.
    """
    lines = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(lines_of("text")).alias("pos", "line"))
    keys = lines.filter(F.length("line") >= min_chars).withColumn("key", key_of(F.col("line"))).filter(F.length("key") >= min_chars)
    return keys.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper): hashes in ``min_docs`` documents or more, and the largest id among those.

    Pairs of hash and document are made distinct before hashes are counted, both with partial
    aggregates: a line of a third of all documents is a few rows for each task in the second shuffle.
    """
    pairs = lines.select("h1", "h2", "doc_id").distinct()
    return pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("keeper")).filter(F.col("_n") >= min_docs).drop("_n")


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, gone): positions of the lines to drop, for texts that lose any.

    The join by hash has no other operator between it and its shuffles, so that a frequent hash can be split.
    """
    lines = long_lines(docs, min_chars)
    hit = lines.join(stored(shared_keys(lines, min_docs), "shared-lines"), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # Rows alike in id and text have the same positions: a set.
    return hit.groupBy(F.struct("doc_id", "text_key").alias("row")).agg(F.collect_set("pos").alias("gone"))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, text, n_lines, n_dropped), a row for each row of ``docs``.

    ``text`` is the text without the dropped lines (empty if all go), ``row`` holds all columns of
    ``docs`` as they were, so none can clash.
    """
    rows = docs.select("doc_id", F.struct(F.col("doc_id"), text_key().alias("text_key")).alias("_at"), F.struct("*").alias("row"), lines_of("text").alias("_lines"))
    met = rows.join(dropped(docs, min_chars, min_docs).withColumnRenamed("row", "_at"), "_at", "left")
    # Lines are looked up by position below the join, where they are a column and not split again.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n"))
    return met.select("doc_id", "row", F.coalesce(text, F.lit("")).alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def without_shared_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` with the columns it has, and texts without the dropped lines."""
    out = drop_shared_lines(docs, **limits)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, row_id, i AS pos, parts[i] AS line, translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
  FROM (SELECT doc_id, row_id, parts, unnest(generate_series(1, len(parts))) AS i
        FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) + CAST(count(*) > count(doc_id) AS INTEGER) >= {MIN_DOCS}),
marked AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id, doc_id
"""
