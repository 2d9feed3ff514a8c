"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for each operator and stage."""

from pathlib import Path

import corpus_pipeline
import pytest
from flowspark.llm import html_blocks, mixing, personal_data, quality_rules, queries, secret_scan, shingle_sets, simhash, string_tiling, token_count, toxicity, training_order
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, toxic string, size string, score string, slot string, part string, kind string, row string, copies string, _id long"
TEXTS = [None, "", " \n\t ", "word", "very long " * 60_000, "x" * 300_000, "same text here for all of them to see", "same text here for all of them to see", "漢字 \U0001f600 \x00 end", "1" * 40_000, "a@b.c " * 2000]


@pytest.fixture(scope="module")
def odd(spark):
    clash = ("c",) * 9 + (1,)
    rows = [(i if i else None, t, None, None if i % 3 else "s", None, *clash) for i, t in enumerate(TEXTS)]
    rows += [(6, TEXTS[6], "en", "s", 1, *clash)] * 2
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, None), (None, 1, 1), (4, 1, 1), (6, 0, 0), (5, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "same text here for all of them to see"), (3, "short one"), (4, "very long " * 20)], "item_id long, text string")


def operators(labels, bench):
    ranks, pattern, eos = queries.byte_vocabulary()
    vocabulary = {"▁": -1.0, "▁a": -2.0, "a": -3.0, "ar": -4.0}
    return {
        "mix": lambda d: mixing.mix(d),
        "tokens": lambda d: token_count.count_tokens(d, vocabulary),
        "quality": lambda d: quality_rules.judge(d, labels),
        "personal": lambda d: personal_data.digest(personal_data.find(d)),
        "toxicity": lambda d: toxicity.score(d, labels),
        "simhash": lambda d: simhash.near_duplicates(d),
        "secrets": lambda d: secret_scan.scan(d),
        "tiling": lambda d: string_tiling.contaminated(d, bench),
        "order": lambda d: training_order.ordered_digest(d.coalesce(1), ranks, pattern, eos, 64, 4096),
    }


PER_ROW = ("mix", "tokens", "quality", "personal", "toxicity", "simhash")
ALL = (*PER_ROW, "secrets", "tiling", "order")


@pytest.mark.parametrize("name", ALL)
def test_odd_rows(spark, odd, labels, bench, name):
    rows = operators(labels, bench)[name](odd).collect()
    if name in PER_ROW:
        assert len(rows) == odd.count()
    if name == "tiling":
        assert {r["doc_id"] for r in rows} == {4, 6, 7}
    if name == "quality":
        assert {r["n_words"] for r in rows if r["doc_id"] in (None, 1, 2)} == {0}
        assert not any(r["kept"] for r in rows if r["doc_id"] in (None, 1, 2, 3))
    if name == "simhash":
        by_id = {r["doc_id"]: r for r in rows}
        assert by_id[7]["component_id"] == 6 and by_id[2]["fingerprint"] == "0" * 16 and by_id[2]["component_id"] == 1
    if name == "order":
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, odd, labels, bench, name):
    assert operators(labels, bench)[name](spark.createDataFrame([], odd.schema)).collect() == []


def stages(labels, bench):
    def near(d):
        prints, _, roots = simhash.grouped(d)
        return simhash.keep_one(d, prints, shingle_sets.near_copies(d, simhash.firsts(prints, roots)))

    return {
        "toxicity": lambda d: toxicity.keep_clean(d, labels),
        "near": near,
        "tiling": lambda d: string_tiling.decontaminate(d, bench),
        "mix": lambda d: mixing.take(d, mixing.drawn(d)),
    }


@pytest.mark.parametrize("name", ["toxicity", "near", "tiling", "mix"])
def test_stages_on_odd_rows(spark, odd, labels, bench, name):
    out = stages(labels, bench)[name](odd)
    assert out.columns == odd.columns
    rows = out.collect()
    kept = {(r["doc_id"], r["text"]) for r in rows}
    assert kept <= {(r["doc_id"], r["text"]) for r in odd.collect()} and all(r["_id"] == 1 and r["fp"] == "c" for r in rows)
    if name == "near":
        assert len(rows) == len(kept) == len({t for _, t in kept}) and (6, TEXTS[6]) in kept
    if name == "tiling":
        assert {i for i, _ in kept} == {None, 1, 2, 3, 5, 8, 9, 10}
    if name == "mix":
        assert len(rows) == sum(r["copies"] for r in mixing.mix(odd).collect())
    assert stages(labels, bench)[name](odd.filter("false")).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_no_labels(spark, odd, labels, bench, name):
    assert operators(labels.filter("false"), bench)[name](odd).count() == odd.count()


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "c"), (2, "u", "", "c"), (2, "u", "<p>x", "c"), (None, "u", "<" * 50_000, "c"), (5, "u", "<div>" * 20_000 + "deep", "c")], "page_id long, url string, html string, text string")
    rows = html_blocks.extract_main_text(pages).collect()
    assert len(rows) == 5 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_blocks.extract_main_text(pages.filter("false")).collect() == []


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        if name != "source_mixing":
            assert kept.exceptAll(before).isEmpty()
        else:
            times = kept.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
            want = mixing.mix(before).filter("copies > 0").groupBy("source").agg(F.sum("copies").alias("n"))
            assert times <= 3 and kept.select("doc_id", "text").distinct().exceptAll(before.select("doc_id", "text").distinct()).isEmpty()
            assert kept.groupBy("source").agg(F.count("*").alias("n")).exceptAll(want).isEmpty()
        if name == "simhash_near_dedup":
            assert kept.count() == kept.select("text").distinct().count()
        if name == "benchmark_decontamination":
            passages = [" ".join(string_tiling.words_of(r["text"])[i].decode() for i in range(len(string_tiling.words_of(r["text"])))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            clean = [" ".join(w.decode() for w in string_tiling.words_of(r["text"])) for r in kept.select("text").collect()]
            assert not any(p in c for p in passages for c in clean)
    rows = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert {i for r in rows for i in r["doc_ids"]} == {r["doc_id"] for r in kept.collect()}


def test_run_clears_what_stages_stored(spark):
    home = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(home.glob("flowspark-*"))
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {p.name.split("-")[1] for p in set(home.glob("flowspark-*")) - before}
    assert left == {"pipeline"} and sorted(r["slot"] for r in rows.collect()) == list(range(rows.count()))
