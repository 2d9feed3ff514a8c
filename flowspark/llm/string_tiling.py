"""Benchmark decontamination by greedy string tiling.

Texts become sequences of words: lower case, ASCII punctuation as space.  Every window of ``SHORTEST``
words of a document is looked up among the windows of the benchmark by a running Karp-Rabin hash;
items that share a seed with the document are tiled: the longest match of words not yet marked in
either text is marked again and again until none of ``SHORTEST`` words is left.  Marked words may lie
in any order, so reordered passages count.  A document is contaminated by an item if marked words
cover at least ``COVERAGE`` of the item, or if one tile has ``PASSAGE`` words.

Items of equal text are one entry.  A benchmark of at most ``BLOCK_WORDS`` words goes to the tasks as a
whole.  A larger one is dealt by a hash into blocks of about that size: one pass over the documents
keeps those that share a seed with any block (by a table of bits, at most ``2**FILTER_BITS`` of them),
then each block meets the documents kept, and its result is stored before the next block is read.
Documents are never shuffled.  Words are compared as exact numbers of the block's vocabulary, so hashes
only find candidates.  Where seeds of one text meet too many of the other (a word repeated over and
over), tiles are found length by length instead, with memory of the two texts' size.

Defined results: null and empty texts, and texts and items under ``SHORTEST`` words, match nothing;
items with equal text or id, and repeated documents, are reported each; an empty benchmark or an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, pick, stored, text_key

#: Words of a seed and of the shortest tile.
SHORTEST = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: Words of a tile that contaminates whatever share of its item it is.
PASSAGE = 50
#: Benchmark words that go to the tasks at once, and log2 of the bits that mark all blocks' seeds.
BLOCK_WORDS, FILTER_BITS = 2_000_000, 30
#: Pairs of equal seeds of a document and a block that are listed; beyond, tiles are found by length.
PAIRS = 1 << 20
#: Words whose hash a task keeps.
CACHE = 300_000

_BASE = 0x9E3779B97F4A7C15
#: A word of ``words_of`` before small letters are made.
_WORD = r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+"
_CLEAN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def windows(ids: np.ndarray) -> np.ndarray:
    """The running hash of each window of ``SHORTEST`` word numbers."""
    with np.errstate(over="ignore"):
        wide = ids.astype(np.uint64)
        n = len(ids) - SHORTEST + 1
        out = np.zeros(max(0, n), np.uint64)
        for k in range(SHORTEST if n > 0 else 0):
            out = out * np.uint64(_BASE) + wide[k : k + n]
    return out


def tile(item: np.ndarray, doc: np.ndarray, item_at: np.ndarray, doc_at: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles (position in the item, position in the document, words), longest first.

    ``item_at`` and ``doc_at`` are the positions of all seeds that the two share.  Seeds that follow
    each other on a diagonal form one maximal match.  A match of which words are marked meanwhile is
    cut down to its free stretches, which wait for their turn by length.
    """
    order = np.lexsort((item_at, doc_at - item_at))
    p, t = item_at[order], doc_at[order]
    new = np.r_[True, (np.diff(p) != 1) | (np.diff(t - p) != 0)]
    first = np.flatnonzero(new)
    runs = np.diff(np.r_[first, len(p)])
    waiting = [(-int(n) - SHORTEST + 1, int(t[i]), int(p[i])) for i, n in zip(first, runs, strict=True)]
    heapq.heapify(waiting)
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles = []
    while waiting:
        n, at_doc, at_item = heapq.heappop(waiting)
        free = item_free[at_item : at_item - n] & doc_free[at_doc : at_doc - n]
        if free.all():
            item_free[at_item : at_item - n] = False
            doc_free[at_doc : at_doc - n] = False
            tiles.append((at_item, at_doc, -n))
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= SHORTEST:
                heapq.heappush(waiting, (a - b, at_doc + a, at_item + a))
    return tiles


def tile_by_length(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """The tiles of :func:`tile`, in order of length, without a list of the seeds' pairs.

    The longest length of which both texts have a free window in common is found by halving; all its
    windows are paired, the first in the document with the first free one in the item; and so on.
    """
    free = [np.ones(len(item), bool), np.ones(len(doc), bool)]
    words = [item.astype(np.uint64), doc.astype(np.uint64)]
    with np.errstate(over="ignore"):
        back = np.uint64(pow(_BASE, -1, 1 << 64))
        sums, unwind = [], []
        for x in words:
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            power = np.cumprod(np.r_[np.uint64(1), np.full(len(x), _BASE, np.uint64)], dtype=np.uint64)
            sums.append(np.r_[np.uint64(0), np.cumsum(x * power[:-1], dtype=np.uint64)])
            unwind.append(np.cumprod(np.r_[np.uint64(1), np.full(len(x), back, np.uint64)], dtype=np.uint64))

    def open_windows(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the free windows of ``n`` words."""
        held = np.r_[0, np.cumsum(free[k])]
        at = np.flatnonzero(held[n:] - held[:-n] == n)
        with np.errstate(over="ignore"):
            return at, (sums[k][at + n] - sums[k][at]) * unwind[k][at]

    def common(n: int) -> bool:
        return bool(np.isin(open_windows(0, n)[1], open_windows(1, n)[1]).any())

    tiles, most = [], min(len(item), len(doc))
    while most >= SHORTEST and common(SHORTEST):
        low, high = SHORTEST, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        waiting: dict[int, list[int]] = {}
        for p, h in zip(*(x[::-1].tolist() for x in open_windows(0, low)), strict=True):
            waiting.setdefault(h, []).append(p)  # the first one is last
        at, hashes = open_windows(1, low)
        known = np.isin(hashes, np.fromiter(waiting, np.uint64, len(waiting)))
        for t, h in zip(at[known].tolist(), hashes[known].tolist(), strict=True):
            places = waiting[h]
            while places and not free[0][places[-1] : places[-1] + low].all():
                places.pop()
            if places and free[1][t] and free[1][t + low - 1] and np.array_equal(item[places[-1] : places[-1] + low], doc[t : t + low]):
                p = places.pop()
                free[0][p : p + low] = free[1][t : t + low] = False
                tiles.append((p, t, low))
        most = low - 1
    return tiles


class Benchmark:
    """A block of items, ready for lookup."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items, hashes, where = [], [], []
        for item_id, text in items:
            words = words_of(text)
            if len(words) < SHORTEST:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            seeds = windows(ids)
            hashes.append(seeds)
            where.append(np.stack([np.full(len(seeds), len(self.items)), np.arange(len(seeds))], axis=1))
            self.items.append((item_id, ids))
        every = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.argsort(every, kind="stable")
        self.seeds, self.where = every[order], np.concatenate([np.empty((0, 2), np.int64), *where])[order]

    def shared(self, text: str | None) -> Iterator[tuple[int | None, int, list[int]]]:
        """(item_id, words of the item, words of each tile) of each item that shares a seed."""
        words = words_of(text)
        if len(words) < SHORTEST or not len(self.seeds):
            return
        doc = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        here = windows(doc)
        low = np.searchsorted(self.seeds, here)
        known = np.minimum(low, len(self.seeds) - 1)
        hits = np.flatnonzero(self.seeds[known] == here)
        if not len(hits):
            return
        low, high = low[hits], np.searchsorted(self.seeds, here[hits], side="right")
        if int((high - low).sum()) > PAIRS:
            spans = np.unique(np.stack([low, high], axis=1), axis=0)
            for i in np.unique(np.concatenate([self.where[a:b, 0] for a, b in spans])).tolist():
                item_id, item = self.items[i]
                if tiles := tile_by_length(item, doc):
                    yield item_id, len(item), [t[2] for t in tiles]
            return
        doc_at = np.repeat(hits, high - low)
        rank = np.arange(len(doc_at)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        found = self.where[np.repeat(low, high - low) + rank]
        order = np.argsort(found[:, 0], kind="stable")
        found, doc_at = found[order], doc_at[order]
        for part in np.split(np.arange(len(found)), np.flatnonzero(np.diff(found[:, 0])) + 1):
            item_id, item = self.items[found[part[0], 0]]
            p, t = found[part, 1], doc_at[part]
            same = (item[p[:, None] + np.arange(SHORTEST)] == doc[t[:, None] + np.arange(SHORTEST)]).all(1)
            if same.any():
                yield item_id, len(item), [t[2] for t in tile(item, doc, p[same], t[same])]


def seed_slots(text: str | None, bits: int, known: dict[bytes, int]) -> np.ndarray:
    """The bits that stand for the seeds of ``text``; they depend on the words alone."""
    words = words_of(text)
    if len(known) > CACHE:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    with np.errstate(over="ignore"):
        mixed = windows(np.fromiter(map(known.__getitem__, words), np.uint64, len(words))) * np.uint64(_BASE)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def marked_seeds(texts: DataFrame, bits: int) -> np.ndarray:
    """The table of ``2**bits`` bits in which every seed of ``texts`` (text) is marked.  Chunks of the table
    are put together by tasks; the driver holds the table."""
    chunk = min(bits, 15)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = np.unique(seed_slots(text, bits, known))
                yield pa.RecordBatch.from_arrays([pa.array(found >> chunk), pa.array(found)], names=["chunk", "slot"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:  # in order of chunk: only the last one can go on
            where, slot = batch.column("chunk").to_numpy(), batch.column("slot").to_numpy()
            for c in np.unique(where).tolist():
                held.setdefault(c, np.zeros(1 << chunk, bool))[slot[where == c] & ((1 << chunk) - 1)] = True
            while len(held) > 1:
                c = min(held)
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(held.pop(c)).tobytes()])], names=["chunk", "bits"])
        for c, b in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(b).tobytes()])], names=["chunk", "bits"])

    spread = texts.select("text").mapInArrow(slots, "chunk long, slot long").distinct().repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros(max(1, 1 << bits >> 3), np.uint8)
    for row in spread.mapInArrow(pack, "chunk long, bits binary").toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        out[row["chunk"] * len(part) : (row["chunk"] + 1) * len(part)] = part
    return out


def sharing(docs: DataFrame, table: np.ndarray, bits: int) -> DataFrame:
    """The rows of ``docs`` (text, ...) with a seed that ``table`` marks; stored."""
    sent = docs.sparkSession.sparkContext.broadcast(table)  # at most 2**FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            slots = (seed_slots(t, bits, known) for t in batch.column("text").to_pylist())
            yield batch.filter(pa.array([bool((sent.value[s >> 3] >> (7 - (s & 7)) & 1).any()) for s in slots], pa.bool_()))

    return stored(docs.mapInArrow(run, docs.schema), "shared-seeds")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, coverage: float, passage: int, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, key, item_key, item_words, tiles, covered, longest): rows of ``docs`` and texts of items, by
    their keys, of which one contaminates the other."""
    schema = "doc_id long, key long, item_key long, item_words int, tiles int, covered int, longest int"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    names = ["doc_id", "key", "item_key", "item_words", "tiles", "covered", "longest"]
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("key", text_key())
    texts = pick(benchmark, text=item_text).withColumn("item_key", text_key()).groupBy("item_key").agg(F.min("text").alias("text"))
    words = texts.agg(F.sum(F.regexp_count("text", F.lit(_WORD)))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS)
    if blocks > 1:
        texts = stored(texts, "benchmark-texts")
        bits = min(FILTER_BITS, max(10, (16 * words).bit_length()))
        rows = sharing(rows, marked_seeds(texts, bits), bits)

    def met(number: int) -> DataFrame:
        block = [(r["item_key"], r["text"]) for r in texts.filter(F.pmod("item_key", F.lit(blocks)) == number).collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Benchmark(block)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE).to_pydict()
                    out = [
                        (d, k, i, n, len(tiles), sum(tiles), max(tiles))
                        for d, k, t in zip(part["doc_id"], part["key"], part["text"], strict=True)
                        for i, n, tiles in known.shared(t)
                        if sum(tiles) >= coverage * n or max(tiles) >= passage
                    ]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        return rows.mapInArrow(run, schema)

    if blocks == 1:
        return met(0)
    found = rows.sparkSession.createDataFrame([], schema)
    for number in range(blocks):
        found = found.unionByName(stored(met(number), "block-overlaps"))
    return found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    passage: int = PASSAGE,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, item_words, tiles, covered, longest, coverage) of every document and item whose
    tiles cover at least ``coverage`` of the item or of which one has at least ``passage`` words."""
    items = pick(benchmark, item_id=item_id, text=item_text).select("item_id", text_key().alias("_of"))
    found = overlaps(docs, benchmark, coverage, passage, doc_id, text, item_id, item_text)
    each = found.join(items, F.col("item_key") == F.col("_of"))
    return each.select("doc_id", "item_id", "item_words", "tiles", "covered", "longest", (F.col("covered") / F.col("item_words")).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, passage: int = PASSAGE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that no benchmark item contaminates.

    Every row is judged by its own text: contaminated rows are joined back by id and text.
    """
    bad = overlaps(docs, benchmark, coverage, passage).select(F.col("doc_id").alias("__leak"), F.col("key").alias("__of")).distinct()
    keyed = docs.withColumn("__key", text_key())
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("__leak")) & (F.col("__key") == F.col("__of")), "left_anti").drop("__key")
