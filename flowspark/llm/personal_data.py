"""Personal data by bootstrapped contextual extraction.

Base entities (e-mail and IP addresses, card and phone numbers with their checks) are seeds.  The one
and two words before and after an entity are its patterns.  Other tokens with digits or an at sign, and
groups of digits, are candidates.

How sure a pattern is follows from the whole corpus: of all places where its words stand, the share
that have a known identifier beside them, where places with a candidate that is not known count half.  So
common words are no patterns, however many identifiers they stand next to.  A pattern is trusted if that share is at least ``LEAST_SCORE`` and ``LEAST_KNOWN``
different identifiers are known there.  Candidates beside a trusted pattern become known themselves,
with the pattern's score as their weight, and count as support of other patterns in the next of
``ROUNDS`` rounds.  Candidates beside a pattern trusted in the end are reported as kind ``id``.

Everything is column expressions and joins.  Edges of patterns and instances are counted before anything
else is done, so a frequent pattern is one row for each of its different instances; only patterns with
``LEAST_KNOWN`` of them are looked at.  What is stored of the instances are hashes.

Defined results: a null or empty text has no spans; repeated rows get equal results; without seeds
nothing is added; an empty table gives an empty result.  Candidates that touch a base span are left
to it; punctuation around a candidate is not part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored
from .spans_sql import matches, words_after, words_before

ROUNDS = 4
LEAST_SCORE, LEAST_KNOWN = 0.6, 5
#: Added to the places of a pattern, so that few places give no high score.
SMOOTHING = 1.0
#: Patterns that are sent to all tasks while places are counted; more of them are joined by a shuffle.
BROADCAST = 1_000_000
#: Code points of a cell in which base spans and candidates meet.
CELL = 256
KINDS = ("email", "ip", "card", "phone")

# The four base patterns.  Possessive and look-behind forms match the same spans without
# going back: no character after a run could have ended the run earlier.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind's pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Groups of digits with single spaces between them, or a run with a digit or an at sign.
CANDIDATE = r"(?<!\S)[0-9]{2,}+(?:\x20[0-9]{2,}+)+(?=[\s.,;:!?)]|$)|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
FOUND = "array<struct<kind:string,start:bigint,end:bigint,before:string,after:string,value:bigint>>"


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.char_length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def located(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, candidates) from (doc_id, text); stored, without the texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("digits", F.col("text").rlike("[0-9]"))
    none = F.array().cast("array<string>")

    def tried(kind: str) -> Column:
        needed = F.col("digits") if kind != "email" else F.lit(True)
        needed = needed & F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else needed
        return F.when(needed, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)

    rows = rows.withColumns({k: tried(k) for k in KINDS} | {"other": F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(none)})

    def spans(name: str, keep, lead=lambda v: F.lit(0), trail=lambda v: F.lit(0)) -> Column:
        """The matches of a kind, less the code points that ``lead`` and ``trail`` say."""

        def bare(m: Column) -> Column:
            value, before, after = m["value"], lead(m["value"]), trail(m["value"])
            return F.struct(
                F.substring(value, before + 1, F.char_length(value) - before - after).alias("value"),
                (m["start"] + before).alias("start"),
                (m["end"] - after).alias("end"),
                F.concat(m["before"], F.left(value, before)).alias("before"),
                F.concat(F.right(value, after), m["after"]).alias("after"),
            )

        every = F.filter(F.transform(matches(F.col("text"), F.col(name), PATTERNS.get(name, CANDIDATE)), bare), lambda m: keep(m["value"]))
        value = lambda m: F.xxhash64(F.lower(m["value"]))
        of = lambda m: F.struct(
            F.lit(name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), words_before(m["before"]).alias("before"), words_after(m["after"]).alias("after"), value(m).alias("value")
        )
        return F.when(F.size(name) > 0, F.transform(every, of)).otherwise(F.array().cast(FOUND)).cast(FOUND)

    # A candidate has five characters and three digits in it, or two characters after an at sign.
    likely = lambda v: (F.char_length(v) >= 5) & (F.regexp_count(v, F.lit("[0-9]")) >= 3) | v.rlike(r"@[\p{L}0-9_]{2}")
    lead = lambda v: F.char_length(F.regexp_extract(v, r"^[^\p{L}0-9@]*+", 0))
    trail = lambda v: F.least(F.char_length(v) - lead(v), F.char_length(F.regexp_extract(F.reverse(v), r"^[^\p{L}0-9]*+", 0)))
    named = rows.select("doc_id", *[spans(k, lambda v, k=k: passes(k, v)).alias(k) for k in KINDS], spans("other", likely, lead, trail).alias("other"))
    base = named.select("doc_id", F.concat(*KINDS).alias("base"), "other")
    return stored(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.col("other").alias("candidates")), "personal-data")


def apart(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, before, after, value) of the candidates that touch no base span; stored.

    Spans meet by cells of ``CELL`` code points, so a text with very many spans is no long comparison.
    """

    def spans(name: str) -> DataFrame:
        return rows.select("row", F.explode(name).alias("s")).select("row", "s.*")

    def cells(df: DataFrame) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))

    taken = cells(spans("base").select("row", "start", "end")).withColumnsRenamed({"start": "from", "end": "upto"})
    touched = cells(spans("candidates")).join(taken, ["row", "cell"]).filter("from < end and start < upto").select("row", "start").distinct()
    return stored(spans("candidates").join(touched, ["row", "start"], "left_anti").select("row", "kind", "start", "end", "before", "after", "value"), "personal-candidates")


def patterns_of(spans: DataFrame) -> DataFrame:
    """``spans`` with ``side`` (l or r) and ``words``: one and two words on each side."""
    side = lambda name, words: F.struct(F.lit(name).alias("side"), words.alias("words"))
    left, right = F.col("before"), F.col("after")
    every = F.array(side("l", F.substring_index(left, " ", -1)), side("l", left), side("r", F.substring_index(right, " ", 1)), side("r", right))
    each = F.filter(F.array_distinct(every), lambda p: p["words"] != "")
    return spans.withColumn("_p", F.explode(each)).select(*spans.columns, "_p.side", "_p.words")


def places(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(words, places): how often each of ``words`` (one or two words) stands in the texts of ``docs``."""
    split = F.split(F.lower(F.trim(F.coalesce("text", F.lit("")))), r"\s+")
    single = docs.select(split.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = single.select(F.explode(F.concat("w", pairs)).alias("words"))
    few = F.broadcast(words) if words.count() <= BROADCAST else words
    return grams.join(few, "words").groupBy("words").agg(F.count(F.lit(1)).alias("places"))


def learn(docs: DataFrame, rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(side, words, score) of the patterns to trust."""
    pattern = ["side", "words"]
    spans = rows.select(F.explode("base").alias("s")).select("s.*").unionByName(candidates.drop("row"))
    each = patterns_of(spans).groupBy(*pattern, "value").agg(F.max(F.col("kind") != "other").alias("seed"), F.count(F.lit(1)).alias("n"))
    each = stored(each, "personal-edges")
    enough = each.groupBy(pattern).agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("own")).filter(F.col("different") >= LEAST_KNOWN)
    counted = places(docs, stored(enough.select("words").distinct(), "personal-words"))
    # Words glued to an identifier do not stand alone in a text: its own places count at least.
    total = stored(enough.join(counted, "words", "left").select(*pattern, F.greatest(F.coalesce("places", F.lit(0)), "own").alias("places")), "personal-places")
    # A pattern with too many places that have neither an identifier nor a candidate is never trusted.
    edges = stored(each.join(total.join(enough, pattern).filter(F.col("own") >= LEAST_SCORE * F.col("places")).select(*pattern, "places", "own"), pattern), "personal-graph")
    known = edges.filter("seed").select("value").distinct().withColumn("weight", F.lit(1.0))
    trusted = edges.select(*pattern, F.lit(0.0).alias("score")).filter("false")
    for _ in range(ROUNDS):
        support = edges.join(known, "value").groupBy(*pattern, "places", "own").agg(F.sum(F.col("weight") * F.col("n")).alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"))
        score = F.col("s") / (F.col("places") - (F.col("own") - F.col("n")) / 2 + SMOOTHING)
        trusted = stored(support.select(*pattern, score.alias("score"), "different").filter((F.col("score") >= LEAST_SCORE) & (F.col("different") >= LEAST_KNOWN)), "personal-trusted")
        met = edges.join(trusted, pattern).groupBy("value").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.col("score"))).alias("weight"))
        known = stored(met.union(edges.filter("seed").select("value", F.lit(1.0))).groupBy("value").agg(F.max("weight").alias("weight")), "personal-known")
    return trusted.drop("different")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, found) for every document: arrays of (kind, start, end) in order."""
    docs = pick(docs, doc_id=doc_id, text=text)
    rows = located(docs)
    candidates = apart(rows)
    trusted = learn(docs, rows, candidates)
    new = patterns_of(candidates).join(trusted, ["side", "words"], "left_semi").groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("found"))
    plain = "array<struct<kind:string,start:bigint,end:bigint>>"
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return rows.select("row", "doc_id", base.alias("base")).join(new, "row", "left").select("doc_id", "base", F.coalesce("found", F.array().cast(plain)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id)."""
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_id"))
