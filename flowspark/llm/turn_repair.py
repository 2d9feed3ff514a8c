"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``.

Time-major tensor DP: conversations are bucketed by length, costs of all states of all conversations of
a bucket are updated turn by turn from the end, stored, and traced from the start, all vectorised.

A conversation is cut into chunks of consecutive turns, each a row with lists, so none is a task of its
own.  Of a conversation with several chunks, each chunk first gives the costs from each state before it
to each state behind it; these small tables are joined up backwards, which gives the costs behind each
chunk; each chunk is traced from each state; and the traces are joined up forwards.

Rows of one turn stand by role, then text; missing turns come first; missing roles and texts are one
space; a missing conv_id is a conversation too.  Repeated rows are kept as one entry with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stored

#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more turn of the only role that may follow (user, but assistant after user).
NEXT = np.array([USER, USER, ASSISTANT, USER])
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 40
#: Costs at the end of a conversation: accepted at the start and after assistant, else by inserts.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: Entries and bytes of text of a chunk, and turns that a slice of a conversation spans.
ENTRIES, CHUNK_BYTES, SPAN = 1024, 1 << 20, 4096
#: Characters that end a sentence, and blanks.
STOPS, BLANKS = ".!?", " \t\n\x0b\x0c\r"
FINE, CUT_OFF, BLANK, REPEAT = range(4)
LETTERS = np.frombuffer(b"\0DKRI", np.uint8)

AT = ["conv_id", "slice", "part"]
CHUNK = "conv_id long, slice long, part long, roles array<string>, texts array<string>, codes binary, times array<long>, first_turn long, last_turn long, n_turns long"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): the planned damage; ``times`` 0 marks a dropped row.

    By ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 removes its stops, 3 repeats
    it, 4 makes its role user.  A null is one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("_way"))
    way = F.col("_way")
    text = F.when(way == 1, "").when(way == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(way == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("times"))


def as_given(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): conversations to be repaired as they stand."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.lit(1).alias("times"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Different rows (conv_id, turn, role, text, times) with ``fault``.

    Rows alike in all columns are counted as partial aggregates; the first turn with a role and text is a
    minimum, again partial, and joined: a text that fills a conversation is no group.
    """
    rows = rows.filter("times > 0").withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = F.struct("conv_id", "role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    rows = rows.withColumns({"_same": same, "_when": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    first = rows.groupBy("_same").agg(F.min("_when").alias("_first"))
    fault = F.when(body == "", BLANK).when(F.col("_when") > F.col("_first"), REPEAT).when(F.right(body, F.lit(1)).isin(*STOPS), FINE).otherwise(CUT_OFF)
    return rows.join(first, "_same").withColumn("fault", fault).drop("_same", "_when", "_first")


def chunks(rows: DataFrame, entries: int = ENTRIES, span: int = SPAN) -> DataFrame:
    """Rows of :func:`with_faults` as chunks (``CHUNK``), in order of slice and part.

    A slice holds the turns of ``span`` consecutive numbers; rows are dealt by conversation and slice and
    read in order; a slice is cut where it has ``entries`` or ``CHUNK_BYTES``.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, size, now = None, 0, 0, ([], [], bytearray(), [], [])

        def made() -> pa.RecordBatch:
            roles, texts, codes, times, turns = now
            known = [t for t in turns if t is not None]
            values = [at[0], at[1], part, roles, texts, bytes(codes), times, min(known, default=None), max(known, default=None), len(set(known))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target, strict=True)], schema=target)

        for batch in batches:
            for piece in by_bytes(batch, "text"):
                for conv, where, turn, role, text, times, fault in zip(*(piece.column(c).to_pylist() for c in ("conv_id", "slice", "turn", "role", "text", "times", "fault")), strict=True):
                    if now[2] and ((conv, where) != at or len(now[2]) >= entries or size >= CHUNK_BYTES):
                        yield made()
                        part, size, now = part + 1 if (conv, where) == at else 0, 0, ([], [], bytearray(), [], [])
                    elif not now[2]:
                        part = 0
                    at = (conv, where)
                    initial = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], 0)
                    again = times if fault in (BLANK, REPEAT) else times - 1
                    for code, n in ((fault, times - again), (BLANK if fault == BLANK else REPEAT, again)):
                        if n:
                            now[0].append(role)
                            now[1].append(text if n and code < BLANK else "")  # deleted: its text is not needed again
                            now[2].append(initial + 4 * code)
                            now[3].append(n)
                            now[4].append(turn)
                    size += len(text)
        if now[2]:
            yield made()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(CHUNK))
    dealt = rows.withColumn("slice", F.coalesce(F.floor(F.col("turn") / span), F.lit(-(1 << 62))))
    ordered = dealt.repartition("conv_id", "slice").sortWithinPartitions("conv_id", "slice", F.asc_nulls_first("turn"), "role", "text")
    return stored(ordered.select("conv_id", "slice", "turn", "role", "text", "times", "fault").mapInArrow(pack, CHUNK), "chunks")


def buckets(codes: list[bytes], times: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which, codes, times), time-major: (turns, conversations), by length to the next power of two.

    Entries beyond the end are deletes that count no times: they cost nothing and leave no letter.
    """
    lengths = np.array([max(len(c), 1) for c in codes])
    classes = np.ceil(np.log2(lengths)).astype(int)
    for k in np.unique(classes):
        which = np.flatnonzero(classes == k)
        c, t = np.full((len(which), 1 << k), 4 * BLANK, np.uint8), np.zeros((len(which), 1 << k), np.int64)
        for i, w in enumerate(which):
            c[i, : len(codes[w])] = np.frombuffer(codes[w], np.uint8)
            t[i, : len(codes[w])] = times[w]
        yield which, c.T, t.T


def options(after: np.ndarray, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of Delete, Keep and Rerole of one turn, (state, ..., conversation), given those behind it."""
    initial, fault = codes & 3, codes >> 2
    extra = np.where(fault >= BLANK, NEVER, np.where(fault == CUT_OFF, TRUNCATED, 0))
    delete, rerole = after + DELETE * times, after[NEXT] + REROLE + extra
    fits = np.full_like(after, NEVER)
    user, system, assistant = (np.broadcast_to(initial == x, after.shape[1:]) for x in (USER, SYSTEM, ASSISTANT))
    for state in (START, SYSTEM, ASSISTANT):
        fits[state] = np.where(user, after[USER], NEVER)
    fits[START] = np.where(system, after[SYSTEM], fits[START])
    fits[USER] = np.where(assistant, after[ASSISTANT], NEVER)
    return delete, np.minimum(fits + KEEP + extra, NEVER), np.minimum(rerole, NEVER)


def inserted(costs: np.ndarray) -> np.ndarray:
    """Costs where turns may be inserted first; more than two in a row never pay."""
    for _ in range(2):
        costs = np.minimum(costs, costs[NEXT] + INSERT)
    return costs


def backward(behind: np.ndarray, codes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Costs before each turn, (turns + 1, state, ..., conversation), from those behind the last."""
    costs = np.empty((len(codes) + 1, *behind.shape), np.int64)
    costs[-1] = behind
    for i in range(len(codes) - 1, -1, -1):
        delete, keep, rerole = options(costs[i + 1], codes[i], times[i])
        costs[i] = inserted(np.minimum(np.minimum(delete, keep), rerole))
    return costs


def forward(costs: np.ndarray, codes: np.ndarray, times: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, state behind): the cheapest edits from ``state``, ASCII-least among equals.

    ``letters``: (turns + 1, three places, conversation), two for inserts before the turn's own edit; after
    the last turn of a conversation (``last``) turns may be inserted too.
    """
    n, m = codes.shape
    letters, each = np.zeros((n + 1, 3, m), np.uint8), np.arange(m)
    state = state.copy()
    for i in range(n):
        delete, keep, rerole = options(costs[i + 1], codes[i], times[i])
        for place in range(2):
            best = costs[i][state, each]
            put = (delete[state, each] != best) & (costs[i][NEXT[state], each] + INSERT == best)
            letters[i, place] = np.where(put, 4, 0)
            state = np.where(put, NEXT[state], state)
        best = costs[i][state, each]
        d, k = delete[state, each] == best, keep[state, each] == best
        letters[i, 2] = np.where(d, 1, np.where(k, 2, 3))
        state = np.where(d, state, np.where(k & (codes[i] & 3 == SYSTEM), SYSTEM, NEXT[state]))
    for place in range(2):
        put = last & ((state == SYSTEM) | (state == USER))
        letters[n, place] = np.where(put, 4, 0)
        state = np.where(put, NEXT[state], state)
    return letters, state


def by_rows(df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, list]], rows: int = 4096) -> DataFrame:
    """``work`` on lists of columns, a bounded number of rows and bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for piece in by_bytes(batch.slice(at, rows), "codes"):
                    yield pa.RecordBatch.from_pydict(work(piece.to_pydict()), schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def passages(rows: dict[str, list]) -> dict[str, list]:
    """For each chunk, the costs from each state before it to each behind it (16 numbers)."""
    out = [None] * len(rows["codes"])
    for which, codes, times in buckets(rows["codes"], rows["times"]):
        unit = np.where(np.eye(4, dtype=bool), 0, NEVER)[:, :, None].repeat(len(which), 2)
        first = backward(unit, codes, times)[0]
        for i, w in enumerate(which):
            out[w] = first[:, :, i].ravel().tolist()
    return {k: rows[k] for k in AT} | {"costs": out}


def traced(rows: dict[str, list], every: bool) -> tuple[list[list[int]], list[list[np.ndarray]]]:
    """(states behind, letters) of each chunk, from its own state before it or from ``every`` one."""
    n = len(rows["codes"])
    states, edits = [[] for _ in range(n)], [[] for _ in range(n)]
    for which, codes, times in buckets(rows["codes"], rows["times"]):
        behind = np.array([rows["behind"][w] for w in which], np.int64).T
        costs = backward(behind, codes, times)
        last = np.array([rows["last"][w] for w in which], bool)
        for before in range(4) if every else [None]:
            start = np.array([rows["before"][w] for w in which] if before is None else [before] * len(which))
            letters, state = forward(costs, codes, times, start, last)
            flat = letters.transpose(2, 0, 1)
            for i, w in enumerate(which):
                states[w].append(int(state[i]))
                edits[w].append(flat[i])
    return states, edits


def joined_up(chunked: DataFrame) -> DataFrame:
    """(conv_id, slice, part, before, behind, last) of the chunks of conversations that have several.

    Each conversation's small tables are read in order by one task, a row at a time.
    """
    several = chunked.groupBy(F.struct("conv_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_c")
    some = chunked.select(*AT, "codes", "times").withColumn("_c", F.struct("conv_id")).join(several, "_c", "left_semi").drop("_c")
    tables = by_rows(some, "conv_id long, slice long, part long, costs array<long>", passages)

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, costs = object(), END
        for batch in batches:
            out = {"behind": [], "last": []}
            for c, table in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist(), strict=True):
                out["last"].append(c != conv)
                costs = END if c != conv else costs
                out["behind"].append(costs.tolist())
                conv, costs = c, np.minimum((np.array(table).reshape(4, 4) + costs[None, :]).min(1), NEVER)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in AT), pa.array(out["behind"], pa.list_(pa.int64())), pa.array(out["last"], pa.bool_())], names=[*AT, "behind", "last"])

    ends = tables.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("slice"), F.desc("part")).mapInArrow(backwards, "conv_id long, slice long, part long, behind array<long>, last boolean")
    at = [some[k].eqNullSafe(ends[k]) for k in AT]
    known = stored(some.join(ends, at).select(*[some[k] for k in AT], "codes", "times", "behind", "last"), "chunk-costs")
    ways = by_rows(known, "conv_id long, slice long, part long, behind array<long>, last boolean, goes array<int>", lambda rows: {k: rows[k] for k in (*AT, "behind", "last")} | {"goes": traced(rows, True)[0]})

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), START
        for batch in batches:
            before = []
            for c, goes in zip(batch.column("conv_id").to_pylist(), batch.column("goes").to_pylist(), strict=True):
                before.append(START if c != conv else state)
                conv, state = c, goes[before[-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*AT, "behind", "last")), pa.array(before, pa.int32())], names=[*AT, "behind", "last", "before"])

    return ways.repartition("conv_id").sortWithinPartitions(*AT).mapInArrow(forwards, "conv_id long, slice long, part long, behind array<long>, last boolean, before int")


REPAIRED = "conv_id long, slice long, part long, audit string, roles array<string>, texts array<string>, cost long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, n_turns long"


def _edit(rows: dict[str, list]) -> dict[str, list]:
    _, edits = traced(rows, False)
    out: dict[str, list] = {k: [] for k in ("audit", "roles", "texts", "cost", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial")}
    for i, (letters,) in enumerate(edits):
        codes, times, old = np.frombuffer(rows["codes"][i], np.uint8), np.array(rows["times"][i], np.int64), rows["roles"][i]
        fault, n = codes >> 2, len(codes)
        # Padding beyond the chunk's entries leaves nothing but what is inserted at the end.
        own, tail = letters[:n], letters[n:]
        repeat = np.ones(own.shape, np.int64)
        repeat[:, 2] = np.where(own[:, 2] == 1, times, 1)
        # Deletes that stand for no row (padding) have no letter.
        tail = np.where(tail == 1, 0, tail).ravel()
        line = np.concatenate([np.repeat(own.ravel(), repeat.ravel()), tail])
        out["audit"].append(LETTERS[line[line > 0]].tobytes().decode())
        roles, texts, state = [], [], rows["before"][i]
        for j, letter in enumerate(np.concatenate([own.ravel(), tail])):
            if letter > 1:
                follows = "assistant" if state == USER else "user"
                kept = letter == 2
                roles.append(old[j // 3] if kept else follows)
                texts.append("" if letter == 4 else rows["texts"][i][j // 3])
                state = SYSTEM if kept and codes[j // 3] & 3 == SYSTEM else NEXT[state]
        out["roles"].append(roles)
        out["texts"].append(texts)
        stays = own[:, 2] > 1
        out["cost"].append(int(DELETE * times[~stays].sum() + REROLE * (own[:, 2] == 3).sum() + INSERT * (line == 4).sum() + TRUNCATED * (stays & (fault == CUT_OFF)).sum()))
        for name, what in (("blank", BLANK), ("duplicate", REPEAT), ("truncated", CUT_OFF)):
            out[name].append(int(times[fault == what].sum()))
        initials = [r[:1] for r in old]
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out["illegal"].append(int(pairs + (times - 1).sum()))
        out["first_initial"].append(initials[0])
        out["last_initial"].append(initials[-1])
    return {k: rows[k] for k in (*AT, "first_turn", "last_turn", "n_turns")} | out


def repair(rows: DataFrame, entries: int = ENTRIES, span: int = SPAN) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, times) repaired, a row for each chunk (``REPAIRED``).

    ``audit`` has a letter for each edit (Keep, Rerole, Delete, Insert); ``roles`` and ``texts`` are the
    repaired turns; ``slice`` and ``part`` give the order of a conversation's chunks.
    """
    chunked = chunks(with_faults(rows), entries, span)
    known = stored(joined_up(chunked), "chunk-states")
    met = chunked.join(known, [chunked[k].eqNullSafe(known[k]) for k in AT], "left")
    ready = met.select(*[chunked[c] for c in chunked.columns], F.coalesce("before", F.lit(START)).alias("before"), F.coalesce("behind", F.array(*[F.lit(int(x)).cast("long") for x in END])).alias("behind"), F.coalesce("last", F.lit(True)).alias("last"))
    return by_rows(ready, REPAIRED, _edit, 256)


def turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, slice, part, place, role, text): the repaired turns, a row each."""
    return repaired.select(*AT, F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")).select(*AT, "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(repaired: DataFrame, conv_ids: Column | DataFrame) -> DataFrame:
    """One row for each of ``conv_ids``: sums over its chunks, its edits and the hash of its turns.

    A task reads the chunks of a conversation in order and feeds them to the hash: of texts, it holds a
    batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), None

        def done() -> tuple:
            n = state["n_turns"]
            gaps = state["last_turn"] - state["first_turn"] + 1 - n if n else 0
            return (conv, gaps, *(state[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(state["audit"]), state["sha"].hexdigest())

        for batch in batches:
            out = []
            for piece in by_bytes(batch, "audit", 1 << 20):
                for r in piece.to_pylist():
                    if r["conv_id"] != conv:
                        if state:
                            out.append(done())
                        conv, state = r["conv_id"], {k: 0 for k in ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns", "kept")} | {"audit": [], "sha": hashlib.sha256(), "end": None, "first_turn": None, "last_turn": None}
                    if r["audit"] is None:  # stands for the conversation itself
                        continue
                    for k in ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"):
                        state[k] += r[k]
                    if state["end"] is not None:
                        state["illegal"] += state["end"] + r["first_initial"] not in ("su", "ua", "au")
                    if r["n_turns"]:
                        state["n_turns"] -= state["last_turn"] == r["first_turn"]  # a turn that is cut
                        state["first_turn"] = r["first_turn"] if state["first_turn"] is None else state["first_turn"]
                        state["last_turn"] = r["last_turn"]
                    state["end"] = r["last_initial"]
                    state["audit"].append(r["audit"])
                    for role, text in zip(r["roles"], r["texts"], strict=True):
                        state["sha"].update((("\n" if state["kept"] else "") + f"{role}:{text}").encode())
                        state["kept"] = 1
            yield _rows(out, target)
        if state:
            yield _rows([done()], target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(DIGEST))
    marks = conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    together = repaired.unionByName(marks, allowMissingColumns=True)
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "part").mapInArrow(run, DIGEST)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
