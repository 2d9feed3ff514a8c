"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; the expected copies of each of its documents are
``target / source size``.  Prefix-summing the expected copies within the source and adding one random
offset, a document is emitted once for each integer that its step of the prefix sum crosses.

The prefix sum is distributed.  Documents of a source are ordered by size class, then by a hash of
the id and the text; ``classes x 2**bucket_bits`` cells of that order are ranked separately and the cells' counts
are summed, so no task sorts a whole source.  Ordering by size class keeps the words taken close to
the target even where a few documents hold most of a source.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a
source without words has target 0 and nothing of it is taken; rows repeated in full are separate
documents, counted as one group first; an empty table gives an empty result.  Only the id, source and text columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

#: Copies of a document at most, and target words at most for each word of a source.
MOST_COPIES = 3
#: Offsets are multiples of 1 / GRAIN, so that whole numbers of copies are summed without rounding.
GRAIN = 1 << 20
#: Copies of a row that one task makes.
RUN = 1024
#: A word and the gaps around it, or a text of gaps only; the group is the word's first character.
AROUND_WORD = r"[\x20\x09-\x0D]*+([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+|[\x20\x09-\x0D]++"


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """Add ``target`` to one row for each source (source, source_size).

    Sources in code-point order, null last, have the weights in turn.  Filling a source to its limit
    and sharing the rest by weight until none is above its limit ends where all open sources hold the
    same words for each unit of weight; in order of limit for each unit of weight, that level follows
    from running sums.  The windows run over the table of sources, one row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = F.col("source_size") * MOST_COPIES
    by_fill = Window.orderBy(limit * F.lit(1.0) / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (
        F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levelled = ranked.withColumn("level", level.cast("double")).withColumn("full", F.col("level") * F.col("weight") > limit)
    # Full sources come first in this order; the first one that is not full sets the level of the rest.
    common = F.min(F.when(~F.col("full"), F.struct(limit * F.lit(1.0) / F.col("weight"), F.col("level")))).over(total)["level"]
    return levelled.select(
        "source", "source_size", F.when(F.col("full"), limit.cast("double")).otherwise(common * F.col("weight")).alias("target")
    )


def words_in(text: Column) -> Column:
    """Number of words.  Each becomes one character: counting matches would hold all words of a text as objects."""
    return F.coalesce(F.char_length(F.regexp_replace(text, F.lit(AROUND_WORD), F.lit("$1"))), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes for each doubling."""
    return F.floor(F.log2(size + F.lit(1.0)) * 8).cast("int")


def spot(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Where a row stands within its size class: 64 bits of its id and text."""
    return F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary")), 1, 16)


def drawn(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    seed: int = 11,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    bucket_bits: int = 8,
) -> DataFrame:
    """(doc_id, source, spot, size, n, source_size, target, rank, offset, rate): one row for the ``n`` rows
    that are alike, with the number ``rank`` of the source's rows before them and the ``rate`` of each."""
    rows = pick(docs, doc_id=doc_id, source=source, text=text).select(
        "doc_id", "source", words_in(F.col("text")).alias("size"), spot().alias("spot")
    )
    # Rows that are alike are counted before they are moved: an id that many rows share is no hot key.
    alike = rows.groupBy("doc_id", "source", "spot", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("class", size_class(F.col("size")))
    alike = alike.withColumn("bucket", F.shiftright(F.conv(F.substring("spot", 1, 4), 16, 10).cast("int"), 16 - bucket_bits))
    alike = stored(alike, "sizes")  # the texts are read once
    cell = ["source", "class", "bucket"]
    counts = alike.groupBy(cell).agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("words"))
    earlier = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n", "words")
    shares = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    draw = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1, 5)
    offset = F.conv(draw, 16, 10).cast("double") / F.lit(float(GRAIN))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cells = (
        starts.withColumnRenamed("source", "s")
        .join(shares.withColumns({"rate": rate, "offset": offset}), F.col("s").eqNullSafe(F.col("source")))
        .drop("s")
    )
    within = Window.partitionBy(*cell).orderBy("spot", "doc_id", "size")
    placed = alike.withColumn("before", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    joined = placed.alias("d").join(
        cells.alias("c"),
        F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.class") == F.col("c.class")) & (F.col("d.bucket") == F.col("c.bucket")),
    )
    return joined.select("d.doc_id", "d.source", "d.spot", "d.size", "d.n", "c.source_size", "c.target", (F.col("c.start") + F.col("d.before")).alias("rank"), "c.offset", "c.rate")


def crossings(after: Column) -> Column:
    """Whole numbers that the prefix sum has passed ``after`` rows."""
    return F.floor(F.col("offset") + after * F.col("rate"))


def spread(df: DataFrame, times: str, out: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 by ``out``.

    A row that is repeated over ``RUN`` times becomes runs of ``RUN`` first, and these are dealt to all tasks: no
    task and no array holds all copies of a row.
    """
    numbered = lambda rows, first, n: rows.withColumn(out, F.explode(F.sequence(first, first + n - 1)))
    n, zero = F.col(times).cast("long"), F.lit(0).cast("long")
    few = numbered(df.filter(n.between(1, RUN)), zero, n).select(*df.columns, out)
    runs = df.filter(n > RUN).withColumn("__run", F.explode(F.sequence(zero, F.floor((n - 1) / RUN)))).repartition("__run", times)
    first = F.col("__run") * RUN
    return few.unionByName(numbered(runs, first, F.least(F.lit(RUN).cast("long"), n - first)).select(*df.columns, out))


def mix(docs: DataFrame, *args, **named) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for every document; arguments of :func:`drawn`.

    ``seed`` sets each source's offset; the same rows and seed give the same copies, whatever the
    partitioning.  ``bucket_bits`` (0 to 16) sets how many cells a size class of a source has.
    """
    each = spread(drawn(docs, *args, **named), "n", "i").withColumn("i", F.col("i") + 1)
    at = F.col("rank") + F.col("i")
    return each.select("doc_id", "size", "source", "source_size", "target", (crossings(at) - crossings(at - 1)).cast("long").alias("copies"))


def take(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text, ...), each as often as ``groups`` of :func:`drawn` says.

    Rows alike in id, source and text share their copies evenly; what is left over goes to one of them.
    """
    wanted = groups.select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("spot").alias("__of"), "n", (crossings(F.col("rank") + F.col("n")) - crossings(F.col("rank"))).alias("all")
    )
    wanted = stored(wanted.select("__id", "__source", "__of", F.floor(F.col("all") / F.col("n")).cast("int").alias("__each"), F.pmod("all", "n").cast("int").alias("__rest")).filter("__each + __rest > 0"), "mix")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__spot") == F.col("__of"))
    rows = docs.withColumn("__spot", spot())
    times = lambda df, n: spread(df, n, "__copy").select(*docs.columns)
    out = times(rows.join(wanted.filter("__each > 0"), same), "__each")
    rest = wanted.filter("__rest > 0")
    if not rest.isEmpty():
        out = out.unionByName(times(rows.join(rest, same).dropDuplicates(["doc_id", "source", "__spot"]), "__rest"))
    return out


#: DuckDB SQL with the rows of the query for ``mix``.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16) AS spot
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sizes
), ordered AS (
  SELECT *, 3 * source_size AS most, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, encode(source) NULLS LAST) AS n FROM weighted
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM ordered
), targets AS (
  SELECT source, source_size,
         CASE WHEN level * weight > most THEN most::DOUBLE ELSE weight * arg_min(level, n) FILTER (level * weight <= most) OVER () END AS target
  FROM levels
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(log2(size + 1.0::DOUBLE) * 8), spot, doc_id, size) AS place
  FROM docs
), rated AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('11:' || coalesce(p.source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS start
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, (floor(start + place * rate) - floor(start + (place - 1) * rate))::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM copied
"""
