"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``distance`` bits are linked; documents reachable through links
form a component.  Copies share a fingerprint, so all later work is on distinct fingerprints.

1. The 64 bits are grouped into ``m`` partitions, correlated bits together (measured on a bounded
   sample of distinct fingerprints; the grouping affects cost only).
2. Partition ``i`` gets a radius ``t_i >= -1`` (-1: not probed) with ``sum(t_i) = distance - m + 1``.
   Then any two linked fingerprints are within ``t_i`` in some partition, or the distances of the
   partitions would add up to ``sum(t_i + 1) = distance + 1``.  Dynamic programming picks the radii
   (and the best ``m``) of least estimated cost: probes sent plus candidates compared.
3. Every fingerprint stands in the bucket of its own partition value and probes all values within
   the radius.  A bucket is compared block against block with numpy; what leaves a task are the edges
   of a spanning forest of the links found there, never all pairs.
4. Forest edges are joined into components by alternating large-star and small-star steps.

Buckets above ``block`` members are cut into blocks and every pair of blocks is its own group of
rows, so a hot bucket is spread over many tasks and no comparison is left out.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like any other;
repeated rows and repeated ids are copies; a null doc_id never becomes a component's id unless every
id in the component is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, pick, stored, text_key

BITS = 64
#: Distinct fingerprints from which the cost of partitions is estimated.
SAMPLE = 20_000
#: Cost of a probe against that of comparing two fingerprints.
PROBE_COST = 150.0
#: Tasks that a component's fingerprints are dealt to.
SALTS = 32
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits, each set if over half of the shingles' XXH64 have it set; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, fp): the key of the text and its fingerprint as a signed 64-bit number."""

    def start():
        def work(rows: dict[str, list]) -> dict[str, list]:
            found = [fingerprint(t, width) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "key": rows["key"], "fp": [x - (1 << 64) if x >> 63 else x for x in found]}

        return work

    return map_rows(pick(docs, doc_id=doc_id, text=text).withColumn("key", text_key()), "doc_id long, key long, fp long", start)


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits of near equal size; each takes the free bit most correlated with it."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    centred = bits - bits.mean(0) if len(bits) else np.zeros((1, BITS))
    spread = np.sqrt((centred**2).sum(0))
    spread[spread == 0] = 1.0
    alike = np.abs(centred.T @ centred) / np.outer(spread, spread)
    free, groups = list(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        mine = [free.pop(0)]
        while len(mine) < width:
            mine.append(free.pop(int(np.argmax(alike[np.ix_(free, mine)].sum(1)))))
        groups.append(sorted(mine))
    return groups


def values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits (0 is the highest) of each fingerprint as one number."""
    out = np.zeros(len(fps), np.uint64)
    for b in bits:
        out = (out << np.uint64(1)) | ((fps >> np.uint64(BITS - 1 - b)) & np.uint64(1))
    return out


def flips(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``width`` bits."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(width), r)]
    return np.array(masks, np.uint64)


def plan_partitions(sample: np.ndarray, distinct: int, distance: int = 4) -> list[tuple[list[int], int]]:
    """(bits, radius) of the probed partitions, of least estimated cost.

    The number of candidates of a partition at a radius is the number of fingerprints times the
    probes times the chance that two of the sample share the partition's value.
    """
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, distance + 2):
        groups = group_bits(sample, m)
        cost: list[dict[int, float]] = []
        for bits in groups:
            _, counts = np.unique(values(sample, bits), return_counts=True)
            n = max(2, len(sample))
            same = float((counts * (counts - 1)).sum()) / (n * (n - 1))
            same = max(same, 2.0 ** -len(bits))
            by_radius = {-1: 0.0}
            for r in range(0, min(3, distance - m + 1) + 1):
                probes = sum(comb(len(bits), k) for k in range(r + 1))
                by_radius[r] = distinct * probes * (PROBE_COST + distinct * same / 2)
            cost.append(by_radius)
        # After each partition: sum of radii -> (least cost, radii).
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for by_radius in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (c, radii) in state.items():
                for r, more in by_radius.items():
                    if total + r not in step or c + more < step[total + r][0]:
                        step[total + r] = (c + more, [*radii, r])
            state = step
        if (end := state.get(distance - m + 1)) and (best is None or end[0] < best[0]):
            best = (end[0], [(g, r) for g, r in zip(groups, end[1], strict=True) if r >= 0])
    assert best is not None
    return best[1]


def forest(left: np.ndarray, right: np.ndarray | None, distance: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within ``left``, or between ``left`` and ``right``."""
    nodes = left if right is None else np.concatenate([left, right])
    root = np.arange(len(nodes))
    a: list[int] = []
    b: list[int] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    other, shift = (left, 0) if right is None else (right, len(left))
    for at in range(0, len(left), step):
        low = at if right is None else 0
        near = np.bitwise_count(left[at : at + step, None] ^ other[None, low:]) <= distance
        rows, cols = np.nonzero(near)
        rows, cols = rows + at, cols + low + shift
        apart = rows < cols if right is None else slice(None)
        rows, cols = rows[apart], cols[apart]
        while len(rows):
            # Links inside one tree are dropped all at once; each round joins trees along the rest.
            top = np.array([find(x) for x in range(len(nodes))]) if len(rows) > len(nodes) else None
            if top is not None:
                cross = top[rows] != top[cols]
                rows, cols = rows[cross], cols[cross]
                if not len(rows):
                    break
            part = slice(0, max(len(nodes), 1024))
            for x, y in zip(rows[part].tolist(), cols[part].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    a.append(x)
                    b.append(y)
            rows, cols = rows[part.stop :], cols[part.stop :]
    return nodes[np.array(a, np.int64)], nodes[np.array(b, np.int64)]


def pairs_in_order(group: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links connect inside each run of equal ``group`` numbers.

    Runs of at most ``dense`` rows are compared row against the following rows, all runs at once, and
    give their links; longer runs give a spanning forest.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    left, right = [], []
    small = np.repeat(sizes <= dense, sizes)
    for d in range(1, min(dense, int(sizes.max(initial=1)))):
        here = np.flatnonzero((group[d:] == group[:-d]) & small[:-d])
        if not len(here):
            break
        near = (np.bitwise_count(fp[here] ^ fp[here + d]) <= distance) & (own[here] | own[here + d])
        left.append(fp[here[near]])
        right.append(fp[here[near] + d])
    for at, n in zip(starts[sizes > dense].tolist(), sizes[sizes > dense].tolist(), strict=True):
        lives, probes = fp[at : at + n][own[at : at + n]], fp[at : at + n][~own[at : at + n]]
        for x, y in ((lives, None), (lives, probes)):
            if len(x) and (y is None or len(y)):
                a, b = forest(x, y, distance)
                left.append(a)
                right.append(b)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(fps: DataFrame, distance: int = 4, block: int = 4096, dense: int = 64) -> DataFrame:
    """(a, b): edges that connect exactly the distinct fingerprints of ``fps`` (fp) that links
    connect.  ``fps`` should be stored; it is read for the sample and for the probes."""
    distinct = fps.count()
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    plan = plan_partitions(sample, distinct, distance)
    masks = [flips(len(bits), r) for bits, r in plan]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each fingerprint in its own bucket of each partition, and in those that it probes."""
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for i, (bits, _) in enumerate(plan):
                value = values(fp.view(np.uint64), bits)
                for mask in masks[i]:
                    yield pd.DataFrame({"part": np.int32(i), "key": (value ^ mask).view(np.int64), "fp": fp, "own": mask == 0})

    rows = fps.mapInPandas(keyed, "part int, key long, fp long, own boolean")
    # Buckets over `block` rows are cut into blocks; each pair of blocks (i, j), i <= j, is compared.
    # There are at most rows / block such buckets.
    large = rows.groupBy("part", "key").count().filter(F.col("count") > block)
    blocks = F.coalesce(F.ceil(F.col("count") / F.lit(block)), F.lit(1)).cast("int")
    cells = (
        rows.join(large, ["part", "key"], "left")
        .withColumn("blocks", blocks)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "key", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), (F.col("mine") <= F.col("with")).alias("first"), "own", "fp")
    )
    cell = ["part", "key", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def edges(pdf: pd.DataFrame) -> pd.DataFrame:
            group = (pdf[cell] != pdf[cell].shift()).any(axis=1).cumsum().to_numpy()
            fp, own = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
            one = (pdf["i"] == pdf["j"]).to_numpy()
            out = [pairs_in_order(group[one], fp[one], own[one], distance, dense)]
            for _, at in pd.Series(np.flatnonzero(~one)).groupby(group[~one]):
                at = at.to_numpy()
                first = pdf["first"].to_numpy()[at]
                x, y = at[first], at[~first]
                for a, b in ((x[own[x]], y), (x[~own[x]], y[own[y]])):
                    if len(a) and len(b):
                        out.append(forest(fp[a], fp[b], distance))
            a, b = (np.concatenate([e[k] for e in out]).view(np.int64) for k in (0, 1))
            return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            # The last cell of a batch may go on in the next one.
            last = (pdf[cell] == pdf[cell].iloc[-1]).all(axis=1).to_numpy()
            rest = pdf[last].reset_index(drop=True)
            if not last.all():
                yield edges(pdf[~last].reset_index(drop=True))
        if rest is not None and len(rest):
            yield edges(rest)

    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node of its component.

    Large-star and small-star steps alternate until a round changes nothing.  A node's neighbours are
    only ever reduced to their minimum and joined, never gathered; the optimiser splits joins on a
    node with many neighbours.
    """

    def star(both: DataFrame, larger: bool) -> DataFrame:
        """Large: connect each larger neighbour, small: each smaller one and the node, to the minimum."""
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(low, "a")
        if larger:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b")

    def measure(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = measure(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, True).distinct()
        now = cut(star(large, False).distinct())
        was, seen = seen, measure(now)
        if was == seen:
            break
    # Each remaining edge goes from a node to its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(docs: DataFrame, width: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text", block: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, fp) of each row, (fp, first) of each fingerprint with its smallest id, and
    (node, root) of the fingerprints that have links; ``key`` is that of the text."""
    prints = stored(fingerprints(docs, width, doc_id, text), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    return prints, classes, stored(components(links(classes.select("fp"), distance, block)), "roots")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text", block: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    prints, classes, roots = grouped(docs, width, distance, doc_id, text, block)
    linked = roots.join(classes, F.col("node") == F.col("fp")).select("node", "root", "first", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    # A component of very many fingerprints is met by SALTS tasks.
    least = linked.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    changed = linked.join(least, ["root", "salt"]).select("node", "component_id")
    by_class = classes.join(changed, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(by_class, F.col("fp") == F.col("_fp")).select("doc_id", digits.alias("fingerprint"), "component_id")


def firsts(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, first): for each component its row of the smallest id, as (no_id, doc_id, key); rows
    without an id come after the others, and equal ids by ``key``."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    # Copies are reduced before they meet their component.
    least = prints.groupBy("fp").agg(F.min(row).alias("first"))
    return least.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))


def keep_one(docs: DataFrame, prints: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that ``first`` (no_id, doc_id, key) names, one each.

    Every row is judged by id and text, so a row that shares the id of a copy stays; of rows with equal
    id and text one stays.
    """
    keep = first.select(F.col("doc_id").alias("__id"), F.col("key").alias("__of"))
    keyed = docs.withColumn("__key", text_key())
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b)) & (F.col("__key") == F.col("__of"))
    kept = keyed.join(keep, same("doc_id", "__id"), "left_semi")
    again = prints.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__of")).count().filter("count > 1").drop("count")
    again = stored(again, "repeated-rows")
    if not again.isEmpty():
        once = kept.join(again, same("doc_id", "__id"), "left_semi").dropDuplicates(["doc_id", "__key"])
        kept = kept.join(again, same("doc_id", "__id"), "left_anti").unionByName(once)
    return kept.drop("__key")
