"""Readers, writers, views and the book, on small files."""

import gzip
import json
import zipfile

from flowspark.operators import bars, book
from flowspark.plans import views
from flowspark.sources import sinks, trades

MESSAGES = [
    (100, "delta", [["10", "5"]], []),
    (200, "snapshot", [["10", "1"], ["9", "2"]], [["11", "3"], ["12", "0"]]),
    (700, "delta", [["10", "0"], ["8", "4"]], [["11", "1"]]),
    (1199, "delta", [["9", "7"]], []),
    (1201, "delta", [], [["10.5", "2"]]),
    (2300, "snapshot", [["20", "1"]], [["21", "1"]]),
]


def test_book_from_messages(spark, tmp_path):
    lines = [json.dumps({"type": k, "ts": t, "data": {"b": b, "a": a}}) for t, k, b, a in MESSAGES]
    (tmp_path / "book.json").write_text("\n".join([*lines, "{broken"]))
    got = book.reconstruct(trades.book_messages(spark, str(tmp_path / "book.json"), "X"), 1000).orderBy("ts_ms").collect()
    flat = [(r.ts_ms, [tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in got]
    assert flat == [
        (200, [(10.0, 1.0), (9.0, 2.0)], [(11.0, 3.0)]),
        (1201, [(9.0, 7.0), (8.0, 4.0)], [(10.5, 2.0), (11.0, 1.0)]),
        (2300, [(20.0, 1.0)], [(21.0, 1.0)]),
    ]


def test_zipped_trades_with_and_without_header(spark, tmp_path):
    rows = ["7,100.5,2,0,0,1700000000000,true", "8,101,3,0,0,1700000000500,False"]
    head = "agg_id,price,qty,first,last,ts,maker"
    for name, lines in (("a", rows), ("b", [head, *rows])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", "\n".join(lines))
    got = trades.trades_zip(spark, str(tmp_path / "*.zip"), "X").orderBy("agg_id").collect()
    assert [(r.agg_id, r.price, r.qty, r.ts_ms, r.is_buyer_maker) for r in got] == [(7, 100.5, 2.0, 1700000000000, True)] * 2 + [(8, 101.0, 3.0, 1700000000500, False)] * 2


def test_gzipped_trades(spark, tmp_path):
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("timestamp,symbol,side,size,price\n1700000000.25,X, Sell ,2,100.5\n1700000001,X,Buy,1,101\nbad,X,Buy,1,101\n")
    got = trades.trades_gz(spark, str(tmp_path / "t.csv.gz"), "X").orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.price, r.qty, r.is_buyer_maker) for r in got] == [(1700000000250, 100.5, 2.0, True), (1700000001000, 101.0, 1.0, False)]


def test_written_rows_come_back(spark, tmp_path):
    df = spark.sql("SELECT 'X' AS symbol, DATE'2024-01-01' AS dt, id * 40000 AS ts_ms, IF(id = 3, NULL, id / 2) AS v FROM range(50)")
    sinks.write_days(df, str(tmp_path / "days"), 3)
    back = spark.read.parquet(str(tmp_path / "days"))
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, schema=df.schema).exceptAll(df).count() == 0
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json"), schema=df.schema).exceptAll(df).count() == 0


def test_views(spark):
    names = views.register(spark, "/root/testdata/sf0.001")
    counts = {n: spark.sql(f"SELECT count(*) AS n FROM {n}").first().n for n in names}
    assert counts["ticks"] == 1000 and counts["bars"] == spark.sql("SELECT sum(lots) DIV 500 AS n FROM ticks").first().n and counts["book"] == counts["ladder"] > 0


def test_trades_become_bars(spark, tmp_path):
    """Two files, of which the later is read first: sizes to lots, one order over both, no odd numbers."""
    rows = {"b": [(20, "Buy", 0.003, 102.0), (21, "Sell", 0.004, 103.0), (22, "Buy", "NaN", 1.0), (23, "Buy", "inf", 1.0), (24, "Buy", 0.0001, 1.0)], "a": [(10, "Sell", 0.004, 100.0), (11, "Buy", 0.002, 101.0), (11, "Buy", 0.002, 100.5)]}
    for name, lines in rows.items():
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write("timestamp,side,size,price\n" + "\n".join(f"{1700000000 + t},{s},{q},{p}" for t, s, q, p in lines) + "\n" * (name == "b") + " \n" * 50 * (name == "b"))
    lots = trades.as_lots(trades.trades_gz(spark, str(tmp_path / "*.gz"), "X"), 0.001)
    assert [(r.seq, r.lots, r.price) for r in lots.orderBy("seq").collect()] == [(0, 4, 100.0), (1, 2, 101.0), (2, 2, 100.5), (3, 3, 102.0), (4, 4, 103.0)]
    got = bars.volume_bars(lots, 5).orderBy("bar_id").collect()
    assert [(r.open, r.close, r.trade_count) for r in got] == [(100.0, 101.0, 2), (101.0, 102.0, 3), (102.0, 103.0, 2)]
    assert trades.time_range(lots, 1700000010000, 1700000020000).count() == 3


def test_zipped_book_and_its_depth(spark, tmp_path):
    lines = [json.dumps({"type": k, "ts": t, "data": {"b": b, "a": a}}) for t, k, b, a in MESSAGES]
    with zipfile.ZipFile(tmp_path / "2024-01-01_X_ob500.data.zip", "w") as z:
        z.writestr("x.data", "\n".join([*lines, "{broken"]))
    got = book.reconstruct(trades.book_messages(spark, str(tmp_path / "*.zip"), "X"), 1000)
    assert sorted(r.ts_ms for r in got.collect()) == [200, 1201, 2300]
    assert trades.depth_of("2024-01-01_X_ob500.data.zip") == 500 and trades.depth_of("x.zip") is None


def test_dates_and_sets(spark):
    assert [str(r.dt) for r in trades.date_list(spark, "2024-02-28", "2024-03-01").collect()] == ["2024-02-28", "2024-02-29"]
    assert trades.date_list(spark, "2024-03-01", "2024-03-01").count() == 0 and trades.date_list(spark, "2024-03-01", "2024-03-01", True).count() == 1
    a = spark.createDataFrame([("X", 2, 0), ("X", 1, 0)], "symbol string, ts_ms long, seq long")
    both = trades.union_ordered(a, a.limit(1)).orderBy("seq")
    assert [(r.ts_ms, r.seq) for r in both.collect()] == [(1, 0), (2, 1), (2, 2)]  # equal trades of two files are two
