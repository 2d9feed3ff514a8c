"""Training-order materialisation: token sequences in fixed-stride binary shards.

The token streams of all documents, each ended by ``eos``, are joined and cut into sequences of
``length`` tokens; the last one is padded with ``eos``.  A keyed Feistel permutation with
cycle-walking gives sequence ``i`` of ``n`` its global slot, so the training order needs no sort of
random numbers and any slot can be traced back.  Slot ``s`` is record ``s % shard_records`` of shard
``s // shard_records``.

1. A counting pass tokenises and keeps, for each document, its place: input partition, offset in the
   partition's stream, tokens.  Prefix sums over partitions give each partition its place in the
   joined stream.
2. A second pass tokenises again and sends each document's fragments straight to the task of their
   shard (ranges of slots, known without sampling).  The task puts fragments in order and writes the
   shard.  Tokenising twice takes less disk than storing all tokens.  If a partition has not as many
   tokens as in the first pass, the job stops with an error, as its numbers would be wrong.

A shard is a file of records: the sequence number in 8 bytes and the tokens in 2 bytes each, both
little-endian, and a line end.  Spark's own text writer writes it, so a repeated or lost task leaves
no partial shard on any file system that Spark knows.  The file of shard ``k`` is ``part-<k>-...``:
a reader that stopped at slot ``s`` goes on there by one seek.

Defined results: a null or empty text is a document of one ``eos``; repeated rows are documents of
their own; a null id stands in ``doc_ids`` as null; an empty table gives no shard and an empty result.  ``docs`` must give the same rows in
the same order when it is read again, as tables in files do.
"""

from __future__ import annotations

import base64
import hashlib
import math
import sys
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, by_bytes, pick, scratch, stored, words_by_space

#: The part of a pattern that looks ahead in white space, and white space.
LOOK_AHEAD = r"\s+(?!\S)|"
_WHITE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITE_RUN = f"{_WHITE}{{2}}|^{_WHITE}|{_WHITE}$"
#: Bytes of text that are encoded at once: the larger, the fewer words are encoded again, and the more
#: memory is held (some ten times as much).
ENCODED = 6 << 20
ROUNDS = 6
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of 0 .. n-1."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        self.half = max(1, math.ceil(max(1, (max(1, n) - 1).bit_length()) / 2))
        digest = hashlib.sha256(f"{key}".encode()).digest() + hashlib.sha256(f"{key}+".encode()).digest()
        self.keys = np.frombuffer(digest, "<u8")[:ROUNDS]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (_scramble(left ^ key) & mask), left
            else:
                left, right = right, left ^ (_scramble(right ^ key) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        """Apply until the number is below n again; the domain is at most four times n."""
        out = np.asarray(x, np.uint64).copy()
        with np.errstate(over="ignore"):
            todo = np.arange(len(out))
            while len(todo):
                out[todo] = self._once(out[todo], back)
                todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def load_ranks(tiktoken_file: str) -> dict[bytes, int]:
    with open(tiktoken_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokenizer:
    """Token numbers of texts as bytes, two each.

    No token of the pattern goes on over a single space, and its look-ahead only matters within a run
    of white space.  So texts without such a run are cut at spaces; the different words of a slice are
    encoded in one go, by the pattern without the look-ahead, and Arrow puts the words' bytes in the
    order of the texts.  Texts with a run, or with white space at an end, are encoded whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        make = lambda name, p: tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.careful = make("careful", pattern)
        self.plain = make("plain", pattern.replace(LOOK_AHEAD, "")) if pattern.endswith(LOOK_AHEAD + r"\s+") else self.careful
        self.bytes_of = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, number in ranks.items():
            self.bytes_of[number] = len(token)

    def pieces(self, texts: pa.Array, end: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(table of byte strings, their numbers in the order of the texts, offsets of the texts); each
        text ends with ``end``."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, WHITE_RUN)
        words, numbers, offsets = words_by_space(pc.if_else(whole, "", texts))
        # The empty word stands for texts that are empty or encoded whole.
        filled = pc.if_else(pc.equal(words, ""), "x", words)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(filled)], filled), " ")[0].as_py()
        ids = np.array(array("H", self.plain(" " + joined) if joined else []), np.uint16)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(pc.binary_length(filled).to_numpy() + 1)) + 1
        starts = offsets[:-1]
        heads = [array("H", self.plain(w)).tobytes() if w else b"" for w in words.take(pa.array(numbers[starts])).to_pylist()]
        for row in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            heads[row] = array("H", self.careful(texts[row].as_py())).tobytes()
        sizes = np.concatenate([np.diff(ends, prepend=0) * 2, np.fromiter(map(len, heads), np.int64, len(heads)), [len(end)]])
        places = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        table = pa.Array.from_buffers(pa.binary(), len(sizes), [None, places, pa.py_buffer(b"".join([ids.tobytes(), *heads, end]))])
        numbers = numbers.copy()
        numbers[starts] = len(words) + np.arange(len(heads), dtype=np.int32)
        return table, np.insert(numbers, offsets[1:], len(sizes) - 1), offsets + np.arange(len(offsets))

    def lengths(self, texts: pa.Array, end: bytes) -> np.ndarray:
        """Tokens of each text."""
        table, numbers, offsets = self.pieces(texts, end)
        sizes = pc.binary_length(table).to_numpy().astype(np.int64) // 2
        return np.diff(np.concatenate([[0], np.cumsum(sizes[numbers])])[offsets])

    def stream(self, texts: pa.Array, end: bytes) -> pa.Buffer:
        """The tokens of all texts in a row."""
        table, numbers, _ = self.pieces(texts, end)
        return table.take(pa.array(numbers)).buffers()[2]


@contextmanager
def fixed_splits(spark: SparkSession, docs: DataFrame):
    """While it lasts, files are split alike however many executors there are."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


#: Tasks that write shards, at most.
MOST_TASKS = 4096


def materialise(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    eos: int,
    path: str,
    length: int = 512,
    shard_records: int = 8192,
    key: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    most_tasks: int = MOST_TASKS,
) -> DataFrame:
    """Write the shards to ``path``; return (sequence, slot, doc_ids): the documents in each sequence.

    The tokenizer's tables and one number for each input partition travel with the tasks.  A task writes
    one shard after the other, as many as it takes for ``most_tasks`` tasks to do; the folder's name says how many.
    """
    if len(ranks) >= 1 << 16 or eos >= 1 << 16 or sys.byteorder != "little":
        raise ValueError("token numbers take two bytes, the lower one first")
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text)
    end = np.array([eos], "<u2").tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, at = Tokenizer(ranks, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in by_bytes(batch, "text", ENCODED):
                sizes = tokens.lengths(some.column("text"), end)
                starts = at + np.concatenate([[0], np.cumsum(sizes)])
                at = int(starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").cast(pa.int64()), pa.array([part] * len(sizes), pa.int32()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64())],
                    names=["doc_id", "part", "at", "n"],
                )

    with fixed_splits(spark, rows):
        index = stored(rows.mapInArrow(count, "doc_id long, part int, at long, n long"), "token-index")
        sums = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.sum("n").alias("n")).collect()}
        parts = max(sums, default=-1) + 1
        sizes = np.array([sums.get(p, 0) for p in range(parts)], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        total = int(offsets[-1])
        n = -(-total // length)
        shards = -(-n // shard_records)
        order = Permutation(n, key)

        def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, part = Tokenizer(ranks, pattern), TaskContext.get().partitionId()
            begin = at = int(offsets[part]) if part < parts else 0
            for batch in batches:
                for some in by_bytes(batch, "text", ENCODED):
                    stream = tokens.stream(some.column("text"), end)
                    upto = at + stream.size // 2
                    sequence = np.arange(at // length, -(-upto // length))
                    edges = np.clip(np.append(sequence, sequence[-1] + 1) * length, at, upto)
                    slot = order.slot(sequence)
                    cuts = pa.py_buffer(((edges - at) * 2).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((slot // shard_records).astype(np.int32)),
                            pa.array(slot),
                            pa.array(sequence),
                            pa.array((edges[:-1] - sequence * length).astype(np.int32)),
                            pa.Array.from_buffers(pa.binary(), len(sequence), [None, cuts, stream]),
                        ],
                        names=["shard", "slot", "sequence", "at", "tokens"],
                    )
                    at = upto
            if at - begin != (int(sizes[part]) if part < parts else 0):
                raise RuntimeError(f"partition {part} has other rows than when it was counted; store the documents in files first")

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, sequence, held = -1, 0, []

            def record() -> bytes:
                body = b"".join(held)
                return sequence.to_bytes(8, "little") + body + end * (length - len(body) // 2)

            for batch in batches:
                out = []
                for slot, number, piece in zip(batch.column("slot").to_pylist(), batch.column("sequence").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                    if slot != now:
                        if held:
                            out.append(record())
                        now, sequence, held = slot, number, []
                    held.append(piece)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([record()], pa.binary())], names=["record"])

        if shards:
            each = -(-shards // most_tasks)
            pieces = rows.mapInArrow(fragments, "shard int, slot long, sequence long, at int, tokens binary").withColumn("task", F.floor(F.col("shard") / each).cast("int"))
            ordered = pieces.repartitionById(-(-shards // each), "task").sortWithinPartitions("slot", "at").select("slot", "sequence", "tokens")
            # The bytes are written as they are; a task's shards are whole but for the last one of all, a file each.
            ordered.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("record")).write.option("maxRecordsPerFile", shard_records).text(f"{path}/{each}-a-task")

    places = spark.createDataFrame([(p, int(offsets[p])) for p in range(parts)], "part int, begin long")
    first = F.floor((F.col("begin") + F.col("at")) / F.lit(length))
    spread = index.join(places, "part").select("doc_id", F.explode(F.sequence(first, F.floor((F.col("begin") + F.col("at") + F.col("n") - 1) / F.lit(length)))).alias("sequence"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence"), pa.array(order.slot(batch.column("sequence").to_numpy())), batch.column("doc_ids")], names=["sequence", "slot", "doc_ids"]
            )

    # A sequence holds at most `length` documents.
    ids = F.sort_array(F.collect_list(F.struct("doc_id")))  # a bare null id would be left out
    lists = spread.groupBy("sequence").agg(F.transform(ids, lambda s: s["doc_id"]).alias("doc_ids"))
    return lists.mapInArrow(slots, "sequence long, slot long, doc_ids array<long>")


def read_shards(spark: SparkSession, path: str, length: int = 512, shard_records: int = 8192, from_slot: int = 0) -> DataFrame:
    """(slot, shard, position, sequence, tokens) from slot ``from_slot`` on.

    Shards before it are not opened; each shard is one row of bounded size until it is cut.
    """
    stride = 8 + 2 * length + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    number = lambda n: F.regexp_extract("path", r"/(\d+)-a-task/part-(\d+)-[^/]*-c(\d+)[^/]*$", n).cast("int")
    shard = number(1) * number(2) + number(3)
    wanted = files.filter(shard >= from_slot // shard_records).select(shard.alias("shard"), "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, data = batch.column("shard")[row].as_py(), memoryview(batch.column("content")[row].as_buffer())
                if len(data) % stride:
                    raise ValueError(f"shard {number} is not a whole number of records")
                skip = max(0, from_slot - number * shard_records)
                for at in range(skip, len(data) // stride, SLICE):
                    some = range(at, min(at + SLICE, len(data) // stride))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number * shard_records + i for i in some], pa.int64()),
                            pa.array([number] * len(some), pa.int32()),
                            pa.array(list(some), pa.int32()),
                            pa.array([int.from_bytes(data[i * stride : i * stride + 8], "little") for i in some], pa.int64()),
                            pa.array([bytes(data[i * stride + 8 : (i + 1) * stride - 1]) for i in some], pa.binary()),
                        ],
                        names=["slot", "shard", "position", "sequence", "tokens"],
                    )

    return wanted.mapInArrow(cut, "slot long, shard int, position int, sequence long, tokens binary")


def ordered_digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, eos: int, length: int = 512, shard_records: int = 8192, key: int = 20) -> DataFrame:
    """(slot, shard, position, sequence, doc_ids, tokens_sha256) of all records, read back from shards
    in the shared folder."""
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    held = materialise(docs, ranks, pattern, eos, path, length, shard_records, key)
    empty = "slot long, shard int, position int, sequence long, tokens binary"
    there = read_shards(spark, path, length, shard_records) if not docs.isEmpty() else spark.createDataFrame([], empty)
    digest = there.select("slot", "shard", "position", "sequence", F.sha2("tokens", 256).alias("tokens_sha256"))
    return digest.join(held.drop("slot"), "sequence").select("slot", "shard", "position", "sequence", "doc_ids", "tokens_sha256")
