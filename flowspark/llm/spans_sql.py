"""Positions of regular-expression matches as column expressions.

``split`` and ``regexp_extract_all`` walk through a text alike, so the lengths of the pieces between
matches and of the matches, summed up, are the matches' places in code points.  Sums are taken in
blocks: a text with very many matches costs no more than ``BLOCK`` steps for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
#: Code points next to a match that are kept.
NEAR = 82


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not at every use in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """For each number of an array the sum of those before it."""
    start = lambda at: F.struct(at.cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
    run = lambda items, at: F.aggregate(items, start(at), step, lambda acc: acc["a"])
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / F.lit(BLOCK)).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    return let(numbers, lambda x: let(cut(x), lambda blocks: F.flatten(F.zip_with(blocks, run(F.transform(blocks, total), F.lit(0)), run))))


def words_before(text: Column) -> Column:
    """The last two words of a text, lower case; words of over 40 code points are cut."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_extract(F.right(text, F.lit(NEAR)), r"(\S{1,40}\s+)?\S{1,40}\s*$", 0), r"\s+", " ")))


def words_after(text: Column) -> Column:
    """The first two words of a text, likewise."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_extract(F.left(text, F.lit(NEAR)), r"^\s*\S{1,40}(\s+\S{1,40})?", 0), r"\s+", " ")))


def matches(text: Column, found: Column, pattern: str) -> Column:
    """``found``: all matches of ``pattern`` in ``text``.  Array of (value, start, end, before, after), or
    an empty one; ``before`` and ``after`` are code points next to the match, ``NEAR`` of them where the
    text and one more match reach as far."""
    tail = lambda c: F.right(F.coalesce(c, F.lit("")), F.lit(NEAR))
    whole = lambda p: (F.char_length(p["gap"]) + F.char_length(p["value"])).cast("long")

    def place(p: Column, at: Column) -> Column:
        start = at + F.char_length(p["gap"])
        return F.struct(p["value"].alias("value"), start.alias("start"), (start + F.char_length(p["value"])).alias("end"), p["before"].alias("before"), p["after"].alias("after"))

    def pieces(values: Column, gaps: Column) -> Column:
        return F.transform(
            values,
            lambda v, i: F.struct(
                F.get(gaps, i).alias("gap"),
                v.alias("value"),
                F.concat(tail(F.get(gaps, i - 1)), tail(F.get(values, i - 1)), tail(F.get(gaps, i))).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(NEAR)).alias("after"),
            ),
        )

    kind = "array<struct<value:string,start:bigint,end:bigint,before:string,after:string>>"
    each = let(found, lambda values: let(F.split(text, pattern, -1), lambda gaps: pieces(values, gaps)))
    places = let(each, lambda p: F.zip_with(p, running_sums(F.transform(p, whole)), place))
    return F.when(F.size(found) > 0, places).otherwise(F.array().cast(kind)).cast(kind)
