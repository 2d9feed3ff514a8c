"""Near copies by the Jaccard similarity of five-word shingles.

1. Each text becomes the set of its shingles' 64-bit hashes, and ``BANDS`` keys of ``ROWS`` minima of
   that set.  Two texts of similarity s share a key with probability ``1 - (1 - s**ROWS)**BANDS``:
   0.9994 at 0.8.
2. Texts with a key in common are candidates, unless their sizes rule out the similarity.  Of keys
   with at most ``SMALL`` texts all pairs are compared, set by set.  In larger ones all texts are
   compared with one of them, and the pairs that have the similarity are joined into components.
3. What is left of a larger key are pairs between two of its components.  They are compared by
   their minima, in blocks, and those that may have the similarity by the ``LOWEST`` smallest hashes
   of their sets.  Of sets that have no more than these, that is the whole comparison.  Larger ones,
   if it does not rule them out, are compared by their whole sets: first a spanning forest of those
   that agree most, and, as long as pairs are rejected, more and more of the others.  Pairs within a
   component cannot change it and are not compared.

Defined results: letters A to Z count as small; a text of fewer words than a shingle is one shingle;
texts without words are copies of nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick, stored, text_key
from .simhash import _UPPER, components

BANDS, ROWS = 14, 4
#: Texts of a key of which all pairs are taken.
SMALL = 8
#: Texts of a block of a larger key, minima that likely pairs agree in (of 56; at similarity 0.8 fewer
#: than 34 have a probability of 0.0002), and pairs of a text beside the forest in the first rounds; in each
#: later one they are four times as many.
BLOCK, LIKELY, NEAREST = 512, 34, (0, 0, 0, 4)
#: Hashes of a text that a block has at hand, and standard deviations that a sample of them may fall short of the
#: similarity (with a probability of 0.0002).
LOWEST, SHORT = 512, 3.6
#: Pairs that are looked at one by one before the rest is sifted.
EDGES = 2048
#: Shingles whose minima are taken at once.
CHUNK = 1 << 12
#: Words whose hash a task keeps.
CACHE = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(42).integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """The different hashes of the shingles of ``text``, in order.  ``known``: hashes of words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > CACHE:
        known.clear()
    digest = xxhash.xxh64_intdigest
    for w in set(words).difference(known):
        known[w] = digest(w)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = (out ^ (out >> np.uint64(29))) * _ODD + one[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * _ODD
        return np.unique(out ^ (out >> np.uint64(29)))


def keys(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """``BANDS`` signed 64-bit keys of a set, and the last 16 bits of each of its minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), CHUNK):
            low = np.minimum(low, (hashes[at : at + CHUNK] * _MIX).min(axis=1))
        out = np.arange(BANDS, dtype=np.uint64)
        for column in low.reshape(BANDS, ROWS).T:
            out = (out ^ (out >> np.uint64(29))) * _ODD + column
    return ((out ^ (out >> np.uint64(32))) * _ODD).view(np.int64).tolist(), (low >> np.uint64(32)).astype("<u2").tobytes()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, keys, minima) of every row of ``docs`` (key, text) with words."""

    def start():
        known: dict[bytes, int] = {}

        def work(rows: dict[str, list]) -> dict[str, list]:
            sets = [shingles(t, width, known) for t in rows["text"]]
            found = [keys(s) if len(s) else ([], b"") for s in sets]
            return {"id": rows["key"], "n": [len(s) for s in sets], "keys": [k for k, _ in found], "minima": [m for _, m in found]}

        return work

    return map_rows(docs.select("key", "text"), "id long, n long, keys array<long>, minima binary", start).filter("n > 0")


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, id, n, texts): the keys that several of ``rows`` (id, n, keys) have, with their number."""
    each = rows.select("id", "n", F.explode("keys").alias("key"))
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    return each.join(sizes, "key")


def fits(x: Column, y: Column, least: float) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y)


def first_pairs(shared: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of a small key, and of a large one each text with one text of the key."""
    me = F.struct("id", "n")
    few = shared.filter(F.col("texts") <= SMALL).groupBy("key").agg(F.collect_set(me).alias("m"))
    every = few.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).filter("x.id < y.id")
    large = shared.filter(F.col("texts") > SMALL)
    centre = large.groupBy("key").agg(F.min(F.struct(F.xxhash64("id"), "id", "n")).alias("y"))
    stars = large.join(centre, "key").select(me.alias("x"), "y").filter("x.id <> y.id")
    both = every.select("x", "y").unionByName(stars.select("x", F.struct("y.id", "y.n").alias("y")))
    both = both.filter(fits(F.col("x.n"), F.col("y.n"), least))
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def cells(shared: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, i, j, mine, id, n, minima, root): the texts of large keys, a group for each pair of blocks that can
    have a link between two components.

    Texts of a key's largest component are cut into blocks -1, -2, ..., the others into blocks 0, 1, ...: two
    blocks of the former have nothing to say to each other.  A key of near copies, most of which the first pairs
    have joined, moves its rows once for each block of those that are left.
    """
    large = shared.filter(F.col("texts") > SMALL).join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", "texts", F.coalesce("root", "id").alias("root"))
    large = stored(large, "large-keys")
    counts = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m")).select("key", F.col("m.root").alias("main"), F.col("m.c").alias("in_main"))
    met = large.join(main, "key").filter("texts > in_main")
    inside = F.col("root") == F.col("main")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    met = met.withColumns({"p": blocks(F.col("in_main")), "q": blocks(F.col("texts") - F.col("in_main"))})
    met = met.withColumn("mine", F.when(inside, -1 - F.pmod(F.xxhash64("id"), "p").cast("int")).otherwise(F.pmod(F.xxhash64("id"), "q").cast("int")))
    others = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda v: F.struct(F.least("mine", v).alias("i"), F.greatest("mine", v).alias("j")))
    mains = F.transform(F.sequence(F.lit(1), F.col("p")), lambda d: F.struct((-d).alias("i"), F.col("mine").alias("j")))
    sent = met.withColumn("to", F.explode(F.when(inside, others).otherwise(F.concat(others, mains))))
    return sent.join(rows.select("id", "minima"), "id").select("key", "to.i", "to.j", "mine", "id", "n", "minima", "root")


def likely(x: pd.DataFrame, y: pd.DataFrame, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, row of y, minima that agree) of the pairs whose minima and sizes allow the similarity and whose
    roots differ, and the roots of x and then y as numbers from 0.  ``same``: x and y are one block."""
    mx, my = (np.frombuffer(b"".join(c["minima"]), "<u2").reshape(-1, BANDS * ROWS).T.copy() for c in (x, y))
    nx, ny = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None]
    agree = np.zeros((len(x), len(y)), np.uint8)
    for p, q in zip(mx, my, strict=True):
        agree += p[:, None] == q[None]
    codes = np.unique(np.concatenate([x["root"], y["root"]]), return_inverse=True)[1]
    r, c = np.nonzero((agree >= LIKELY) & (np.minimum(nx, ny) >= least * np.maximum(nx, ny)) & (codes[: len(x), None] != codes[None, len(x) :]))
    edges = np.stack([r, c, agree[r, c].astype(np.int64)], axis=1)
    return (edges[edges[:, 0] < edges[:, 1]] if same else edges), codes


def open_rows(groups: DataFrame, least: float) -> DataFrame:
    """The rows of ``groups`` (see ``cells``) that are in a likely pair of their group."""

    def sift(cell: pd.DataFrame) -> pd.DataFrame:
        i, j = cell["i"].iloc[0], cell["j"].iloc[0]
        x, y = cell[cell["mine"] == i], cell[cell["mine"] == j]
        edges, _ = likely(x, y, i == j, least)
        met = [x.iloc[np.unique(edges[:, 0])], y.iloc[np.unique(edges[:, 1])]]
        return pd.concat(met).drop_duplicates("id")

    return groups.groupBy("key", "i", "j").applyInPandas(sift, groups.schema)


def proposals(groups: DataFrame, rejected: DataFrame, least: float, nearest: int) -> DataFrame:
    """(key, i, j, a, b, sure) of pairs between components: a spanning forest of those whose minima agree most,
    and of larger sets also the ``nearest`` of each text.  ``groups`` have the smallest hashes (low) too.

    Sure pairs were compared in full and have the similarity; pairs of ``rejected`` are known not to.
    """

    def pairs(cell: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if cell.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("key", "i", "j", "a", "b")} | {"sure": pd.Series(dtype="bool")})
        cell = cell.sort_values("id")
        key, i, j = (int(cell[c].iloc[0]) for c in ("key", "i", "j"))
        x, y = cell[cell["mine"] == i], cell[cell["mine"] == j]
        no = set(zip(known["a"].tolist(), known["b"].tolist(), strict=True))
        edges, codes = likely(x, y, i == j, least)
        edges = edges[np.argsort(-edges[:, 2], kind="stable")]
        rx, ry = codes[: len(x)], codes[len(x) :]
        ids_x, ids_y = x["id"].to_numpy(), y["id"].to_numpy()
        root, near_x, near_y, keep = list(range(len(codes))), np.zeros(len(x), int), np.zeros(len(y), int), []
        if i == j:
            near_y = near_x
        lows: dict[int, np.ndarray] = {}
        sizes = dict(zip(cell["id"].tolist(), cell["n"].tolist(), strict=True))
        packed = dict(zip(cell["id"].tolist(), cell["low"], strict=True))
        whole_x, whole_y = x["n"].to_numpy() <= LOWEST, y["n"].to_numpy() <= LOWEST

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        def low(v: int) -> np.ndarray:
            if v not in lows:
                lows[v] = np.frombuffer(packed[v], np.uint64)
            return lows[v]

        def alike(a: int, b: int, whole: bool) -> bool:
            """Whether two sets have the similarity; if they are not ``whole`` here, whether they may have."""
            s, t = low(a), low(b)
            if not whole:
                # Up to the last hash of a set that goes on, both are complete: a sample of their union.
                upto = min(v[-1] for v, n in ((s, sizes[a]), (t, sizes[b])) if n > LOWEST)
                s, t = s[: np.searchsorted(s, upto, "right")], t[: np.searchsorted(t, upto, "right")]
            merged = np.concatenate([s, t])
            merged.sort()
            both = int(np.count_nonzero(merged[1:] == merged[:-1]))
            union = len(merged) - both
            return both >= least * union - (0 if whole else SHORT * (least * (1 - least) * union) ** 0.5)

        while len(edges):
            for r, c, _ in edges[:EDGES].tolist():
                pair = (int(min(ids_x[r], ids_y[c])), int(max(ids_x[r], ids_y[c])))
                p, q = find(rx[r]), find(ry[c])
                whole = bool(whole_x[r] and whole_y[c])
                if (p != q or (not whole and (near_x[r] < nearest or near_y[c] < nearest))) and pair not in no and alike(*pair, whole):
                    root[max(p, q)] = min(p, q)
                    if not whole:
                        near_x[r] += 1
                        near_y[c] += 1
                    keep.append((*pair, whole))
            # What joins nothing new is dropped all at once.
            edges = edges[EDGES:]
            top = np.array([find(v) for v in range(len(root))])
            r, c = edges[:, 0], edges[:, 1]
            wanted = ~(whole_x[r] & whole_y[c]) & ((near_x[r] < nearest) | (near_y[c] < nearest))
            edges = edges[(top[rx[r]] != top[ry[c]]) | wanted]
        out = pd.DataFrame({"key": key, "i": i, "j": j, "a": [k[0] for k in keep], "b": [k[1] for k in keep]}).astype("int64")
        return out.assign(sure=np.array([k[2] for k in keep], bool))

    at = ("key", "i", "j")
    return groups.groupBy(*at).cogroup(rejected.groupBy(*at)).applyInPandas(pairs, "key long, i int, j int, a long, b long, sure boolean")


def compared(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, good): whether the sets (id, hashes) of each pair have the similarity; compared in full."""

    def compare():
        def work(rows: dict[str, list]) -> dict[str, list]:
            out = []
            for x, y in zip(rows["x"], rows["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both >= least * (len(x) + len(y) - both))
            return {"a": rows["a"], "b": rows["b"], "good": out}

        return work

    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a long, b long, good boolean", compare)


def joined_up(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """(node, root) of the texts of ``rows`` (id, n, keys, minima) that have links.  ``sets_of`` gives the sets
    (id, hashes) of some ids.

    Pairs of larger sets that are rejected make room for others, in the end four times as many for each text in each round, until no likely
    pair of a key that was not compared in full stands between two components: no pair is left out for
    the number of a text's neighbours.
    """
    shared = stored(shared_keys(rows), "shared-keys")
    sets = stored(sets_of(shared.select("id").distinct()), "shingle-sets")
    good = stored(compared(sets, first_pairs(shared, least), least).filter("good").select("a", "b"), "alike")
    roots = stored(components(good), "near-roots")
    open_ = open_rows(cells(shared, rows, roots), least)
    groups = stored(open_.join(sets.select("id", F.substring("hashes", 1, 8 * LOWEST).alias("low")), "id"), "cells")
    at, rounds = ["key", "i", "j"], 0
    rejected = groups.select(*at, F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    now = groups
    while True:
        nearest = NEAREST[min(rounds, len(NEAREST) - 1)] * 4 ** max(0, rounds - len(NEAREST) + 1)
        proposed = stored(proposals(now, rejected, least, nearest), "proposed")
        if proposed.isEmpty():
            return roots
        judged = stored(compared(sets, proposed.filter("not sure").select("a", "b").distinct(), least), "judged")
        good = stored(good.union(proposed.filter("sure").select("a", "b")).union(judged.filter("good").select("a", "b")).distinct(), "alike")
        roots = stored(components(good), "near-roots")
        bad = stored(proposed.filter("not sure").join(judged.filter("not good").select("a", "b"), ["a", "b"]).select(*at, "a", "b"), "rejected")
        if bad.isEmpty():
            return roots
        rejected, rounds = stored(rejected.union(bad), "rejected"), rounds + 1
        open_ = groups.join(bad.select(*at).distinct(), at, "left_semi").withColumnRenamed("root", "_old")
        now = open_.join(roots, F.col("id") == F.col("node"), "left").select(*at, "mine", "id", "n", "minima", "low", F.coalesce("root", "_old").alias("root"))


def near_copies(docs: DataFrame, firsts: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``firsts`` (root, first: (no_id, doc_id, key)), rows of different texts in ``docs`` (doc_id, text),
    without those that are near copies of an earlier one: (no_id, doc_id, key).

    The other rows of ``docs`` are not compared.
    """
    first = stored(firsts.select("first.no_id", "first.doc_id", "first.key"), "firsts")
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("key", text_key())
    # Rows with equal texts have one sketch; all pairs and sets are by the text's key.
    sketched = sketches(rows, width).join(first.select(F.col("key").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])

    def to_sets():
        known: dict[bytes, int] = {}

        def work(rows: dict[str, list]) -> dict[str, list]:
            return {"id": rows["key"], "hashes": [shingles(t, width, known).tobytes() for t in rows["text"]]}

        return work

    def sets_of(ids: DataFrame) -> DataFrame:
        named = first.join(ids.withColumnRenamed("id", "key"), "key", "left_semi").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        chosen = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
        return map_rows(chosen.select("key", "text"), "id long, hashes binary", to_sets).dropDuplicates(["id"])

    roots = joined_up(stored(sketched, "sketches"), sets_of, least)
    row = F.struct("no_id", "doc_id", "key")
    merged = first.join(roots, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("root", "key").alias("_root")).agg(F.min(row).alias("first"))
    return merged.select("first.*")
