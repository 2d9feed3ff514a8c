"""Line dedup against a plain count, and on odd rows."""

import random
import re
from collections import defaultdict

import pytest
from flowspark.llm import line_dedup
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, gone string, row string, n_lines string, text_key string, _at string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, min_chars, min_docs):
    docs, keys = defaultdict(set), []
    for doc, text in rows:
        lines = ("" if text is None else text).split("\n")
        keys.append((doc, lines, [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(LOWER) for x in lines]))
        for k in keys[-1][2]:
            if len(k) >= min_chars:
                docs[k].add(doc)
    keeper = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in docs.items() if len(d) >= min_docs}
    out = []
    for doc, lines, own in keys:
        kept = [x for x, k in zip(lines, own) if k not in keeper or keeper[k] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(df, **limits):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_shared_lines(df, **limits).collect()), key=str)


@pytest.mark.parametrize(("min_chars", "min_docs"), [(40, 5), (1, 2), (3, 3)])
def test_by_plain_count(spark, min_chars, min_docs):
    rng = random.Random(min_docs)
    shared = ["A line that many documents have, long enough to count", "a line THAT many documents have, long enough to count", "x" * 39, "É" * 40, "é" * 40, "漢字" * 25, "ab", "abc", "", " " + "y" * 39]
    rows = [(rng.choice([*range(30), None]), "\n".join(rng.choice(["", " ", "\t", "\x0b"]) + rng.choice([*shared, f"own {i} {rng.random()} " + "z" * 40]) + rng.choice(["", " \r", "\x0c"]) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(1, None), (2, ""), (None, "\n\n"), (3, "end\n"), (4, shared[0]), (4, shared[0]), (4, "\n".join([shared[0]] * 300)), (5, "w" * 200_000 + "\n" + shared[0])]
    df = spark.createDataFrame([(*r, "c", "c", "c", "c", "c") for r in rows], SCHEMA)
    assert got(df, min_chars=min_chars, min_docs=min_docs) == expected(rows, min_chars, min_docs)
    again = line_dedup.without_shared_lines(df, min_chars=min_chars, min_docs=min_docs)
    assert again.columns == df.columns and again.filter("gone != 'c'").isEmpty()
    assert sorted(r["text"] for r in again.collect()) == sorted(r[1] for r in expected(rows, min_chars, min_docs))


def test_empty_table_and_hot_line(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    line = "one line of more than forty characters in a third of all documents"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(line + "\nrest "), "id")).otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    out = line_dedup.drop_shared_lines(docs)
    assert [r["doc_id"] for r in out.filter(F.col("text").contains(line)).collect()] == [2997]
    assert out.agg(F.sum("n_dropped")).first()[0] == 999
