"""Conversation repair against a brute-force search for the cheapest, ASCII-least edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from flowspark.llm import queries, turn_repair

COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra over (row, roles so far), by cost and then by the letters."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "fine" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out, faults
        if (i, state) in done:
            continue
        done.add((i, state))
        follows = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, follows[0], (*out, follows + ":")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("fine", "truncated"):
                more = faults[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, follows[0], (*out, f"{follows}:{text}")))
                if role[:1] == follows[0] or role[:1] == "s" and not state:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))


def expected(rows, harm=damaged):
    want = {}
    for conv in {r[0] for r in rows}:
        mine = harm([r for r in rows if r[0] == conv])
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        cost, audit, out, faults = cheapest(mine)
        known = [r[1] for r in mine if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        want[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return want


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in df.select(COLUMNS).collect()}


def made(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            at = turn + rng.choice([0, 0, 0, 5]) if rng.random() < 0.9 else None
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"])
            rows.append((conv, at, role, rng.choice(["Hm.", "Yes!", "no end", "", " \n", None, f"Word {turn}.", f"word {turn}", "Why? \t"])))
    return rows


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op13_turn_repair"](spark, sf)) == expected(rows)


@pytest.mark.parametrize(("entries", "span"), [(1024, 4096), (3, 4096), (2, 4), (1, 1)])
def test_chunks_of_any_size(spark, entries, span):
    rows = made(random.Random(entries), 60, 24)
    rows += [(None, None, None, None), (None, 3, "user", "A."), (-1, 2, "user", "A."), (-2, None, "assistant", "A.")] + [(77, 1, "user", "Same.")] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(turn_repair.digest(turn_repair.repair(turn_repair.damage(df), entries, span), df)) == expected(rows)


def test_undamaged_and_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "More?"), (2, 0, "user", "Q"), (3, 0, "system", "S.")]
    fixed = turn_repair.repair(turn_repair.as_given(spark.createDataFrame(rows, SCHEMA)))
    assert got(turn_repair.digest(fixed, spark.createDataFrame(rows, SCHEMA))) == expected(rows, list)
    turns = sorted((r["conv_id"], r["place"], r["role"], r["text"]) for r in turn_repair.turns(fixed).collect())
    assert turns == [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "More?")]


def test_odd_tables(spark):
    long = [(5, i, "user" if i % 2 == 0 else "assistant", f"{i}. " + "long text " * 20_000 + ".") for i in range(4)]
    df = spark.createDataFrame([(*r, 1, "c") for r in long], SCHEMA + ", slice long, codes string")
    assert got(turn_repair.digest(turn_repair.repair(turn_repair.damage(df)), df)) == expected(long)
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.digest(turn_repair.repair(turn_repair.damage(empty)), empty).collect() == []


def test_one_conversation_with_most_rows(spark):
    rows = [(9, i, "user" if i % 2 else "assistant", "Same words.") for i in range(3000)] + [(9, i, "user", f"{i}.") for i in range(3000, 4000)] + [(1, 0, "user", "Q?")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = turn_repair.repair(turn_repair.damage(df), 64, 128)
    assert got(turn_repair.digest(out, df)) == expected(rows)
    assert out.filter("conv_id = 9").count() > 30
