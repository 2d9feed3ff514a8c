"""The archive source: names, pushed filters, odd files, round trip and digests."""

import datetime
import gzip
import hashlib
import json
import zipfile

import pytest
from flowspark.sources import archives
from pyspark.sql import functions as F

D = datetime.date


def zipped(path, text, inner="x.csv"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(inner, text)


@pytest.fixture
def folder(tmp_path):
    zipped(tmp_path / "AAA-aggTrades-2024-01-01.zip", "﻿agg_id,price,qty,f,l,time,m\n1,10.5,2,0,0,1704067200000,true\n2,11,3e-1,0,0,1704067200500,False\nbad,1,1,0,0,1,true\n4,nan,1,0,0,1704067201000,true\n5,1,,0,0,1704067201000,true\n")
    zipped(tmp_path / "AAA-aggTrades-2024-01-02.zip", "7,12,1,0,0,1704153600000,TRUE\n")
    zipped(tmp_path / "BBB-aggTrades-2024-01-02.zip", "")
    (tmp_path / "CCC2024-01-03.csv.gz").write_bytes(gzip.compress(b"timestamp,symbol,side,size,price\n1704240000.1239,CCC, Sell ,5,1.5\n1704240001,CCC,Buy,x,1\n1704240002,CCC,Buy,6,2\n"))
    (tmp_path / "AAA-aggTrades-2024-01-04.zip").write_bytes(b"no archive at all")
    (tmp_path / "notes.txt").write_text("")
    return tmp_path


def test_only_wanted_archives_are_opened(spark, folder):
    """2024-01-04 is broken: reading it fails, so a range of days that leaves it out must not open it."""
    df = archives.read_archives(spark, str(folder))
    some = df.filter((F.col("dt") >= D(2024, 1, 1)) & (F.col("dt") < D(2024, 1, 4)))
    assert some.rdd.getNumPartitions() == 4
    rows = sorted((r["symbol"], r["seq"], r["ts_ms"], r["price"], r["qty"], r["is_buyer_maker"]) for r in some.collect())
    assert rows == [("AAA", 1, 1704067200000, 10.5, 2.0, True), ("AAA", 2, 1704067200500, 11.0, 0.3, False), ("AAA", 7, 1704153600000, 12.0, 1.0, True), ("CCC", 0, 1704240000123, 1.5, 5.0, True), ("CCC", 2, 1704240002000, 2.0, 6.0, False)]
    one = df.filter((F.col("dt") == D(2024, 1, 2)) & (F.col("symbol") == "AAA") & (F.col("price") > 0))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    assert df.filter(F.col("symbol").isin("BBB", "CCC")).rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="zip"):
        df.filter(F.col("dt") == D(2024, 1, 4)).collect()


def test_books_of_the_depth_of_their_day(spark, tmp_path):
    def book(day, depth, *lines):
        zipped(tmp_path / f"{day}_AAA_ob{depth}.data.zip", "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), "x.data")

    message = lambda ts, kind, b: {"ts": ts, "type": kind, "data": {"b": b, "a": []}}
    book("2025-08-20", 500, message(1, "snapshot", [["1.5", "2"]]), "no json", "", message(2, "delta", [["1.5", "0"], ["x"]]), {"type": "delta"}, [1])
    book("2025-08-20", 200, message(9, "snapshot", []))
    book("2025-08-21", 500, message(9, "snapshot", []))
    book("2025-08-21", 200, message(3, "snapshot", [["1", "1"]]))
    book("2025-08-22", 50, message(4, "snapshot", []))
    df = archives.read_archives(spark, str(tmp_path), "books")
    rows = [(r["ts_ms"], r["seq"], r["type"], [tuple(x) for x in r["b"]]) for r in df.orderBy("ts_ms").collect()]
    assert rows == [(1, 0, "snapshot", [(1.5, 2.0)]), (2, 3, "delta", [(1.5, 0.0), (None, None)]), (3, 0, "snapshot", [(1.0, 1.0)]), (4, 0, "snapshot", [])]
    assert df.filter(F.col("dt") >= D(2025, 8, 21)).rdd.getNumPartitions() == 2


def test_round_trip_and_digests(spark, tmp_path):
    rows = [("AAA", D(2024, 1, 1 + i % 3), 1704067200000 + i, i, i / 3, i / 7, i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, archives.TRADES)
    archives.write_archives(df, str(tmp_path / "a"))
    back = archives.read_archives(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(rows)
    assert back.rdd.getNumPartitions() == 3
    names = sorted(p.name for p in (tmp_path / "a").iterdir())
    for name, make in zip(names, (hashlib.sha256, hashlib.md5, None), strict=True):
        if make:
            (tmp_path / "a" / f"{name}.CHECKSUM").write_text(f"{make((tmp_path / 'a' / name).read_bytes()).hexdigest().upper()}  {name}\n")
    (tmp_path / "a" / "AAA-aggTrades-2024-01-09.zip").write_bytes(b"cut")
    (tmp_path / "a" / "AAA-aggTrades-2024-01-09.zip.CHECKSUM").write_text("0" * 64)
    (tmp_path / "a" / "AAA-aggTrades-2024-01-10.zip").write_bytes(b"cut")
    (tmp_path / "a" / "AAA-aggTrades-2024-01-11.zip").write_bytes(b"")
    (tmp_path / "a" / "AAA-aggTrades-2024-01-11.zip.CHECKSUM").write_text("0" * 64)
    (tmp_path / "a" / "AAA-aggTrades-2024-01-10.zip.CHECKSUM").write_text("abc")
    found = {r["name"][-6:-4]: (r["algorithm"], r["status"]) for r in archives.verify(spark, str(tmp_path / "a"), str(tmp_path / "a")).collect()}
    assert found == {"01": ("sha256", "good"), "02": ("md5", "good"), "03": (None, "no checksum"), "09": ("sha256", "bad"), "10": (None, "unknown algorithm"), "11": ("sha256", "missing or empty")}
