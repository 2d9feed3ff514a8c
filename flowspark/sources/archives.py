"""Daily archives of trades and book messages as a Spark data source.

``spark.read.format("archives").option("kind", "trades").load(folder)`` lists a folder once in the driver
and plans one partition for each archive.  What an archive holds is in its name, so filters on ``symbol`` and
``dt`` are pushed into the listing: archives of other days and instruments are never opened.

Names: ``SYMBOL-aggTrades-YYYY-MM-DD.zip`` and ``SYMBOLYYYY-MM-DD.csv.gz`` for trades,
``YYYY-MM-DD_SYMBOL_obDEPTH.data.zip`` for books.  Of a day's books with several depths, the one that the
venue published then is read: ``DEEP`` levels before ``CHANGED``, ``SHALLOW`` from it on.

Any store that ``pyarrow.fs`` opens will do (local, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import datetime
import gzip
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql import functions as F

TRADES = "symbol string, dt date, ts_ms long, seq long, price double, qty double, is_buyer_maker boolean"
SIDE = "array<struct<price:double,size:double>>"
BOOKS = f"symbol string, dt date, ts_ms long, seq long, type string, b {SIDE}, a {SIDE}"
#: Levels of the books, and the day on which they changed.
DEEP, SHALLOW, CHANGED = 500, 200, datetime.date(2025, 8, 21)
#: Lines of a book that a task holds at once.
LINES = 4096

_TRADES = re.compile(r"(?P<symbol>[^/]+?)(?:-aggTrades-)?(?P<day>\d{4}-\d\d-\d\d)\.(?:zip|csv\.gz)$")
_BOOK = re.compile(r"(?P<day>\d{4}-\d\d-\d\d)_(?P<symbol>[^/]+)_ob(?P<depth>\d+)\.data\.zip$")


@dataclass
class Archive(S.InputPartition):
    path: str
    symbol: str
    day: datetime.date
    depth: int | None = None


def depth_on(day: datetime.date) -> int:
    return SHALLOW if day >= CHANGED else DEEP


def named(path: str, kind: str) -> Archive | None:
    """What the name of a file says; None if it is no archive of the kind."""
    found = (_BOOK if kind == "books" else _TRADES).search(path.rpartition("/")[2])
    if not found:
        return None
    depth = int(found["depth"]) if kind == "books" else None
    return Archive(path, found["symbol"], datetime.date.fromisoformat(found["day"]), depth)


def store(path: str) -> tuple[fs.FileSystem, str]:
    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def listed(folder: str, kind: str) -> list[Archive]:
    """The archives in a folder, of each instrument and day the book with the depth published then (or the
    only one there is)."""
    files, where = store(folder)
    infos = files.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=False))
    found = [a for i in infos if i.type == fs.FileType.File and (a := named(i.path, kind))]
    if kind != "books":
        return sorted(found, key=lambda a: (a.symbol, a.day, a.path))
    best: dict[tuple, Archive] = {}
    for a in sorted(found, key=lambda a: (a.depth != depth_on(a.day), -a.depth, a.path)):
        best.setdefault((a.symbol, a.day), a)
    return sorted(best.values(), key=lambda a: (a.symbol, a.day))


class Reader(S.DataSourceReader):
    """Keeps what the pushed filters leave; ranges of days and sets of instruments are answered by names alone."""

    def __init__(self, folder: str, kind: str, schema) -> None:
        self.folder, self.kind, self.schema, self.tests = folder, kind, schema, []

    def pushFilters(self, filters: list[S.Filter]) -> Iterator[S.Filter]:
        compare = {S.EqualTo: "eq", S.EqualNullSafe: "eq", S.LessThan: "lt", S.LessThanOrEqual: "le", S.GreaterThan: "gt", S.GreaterThanOrEqual: "ge", S.In: "in"}
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if type(f) in compare and name in ("symbol", "dt"):
                self.tests.append((name, compare[type(f)], list(f.value) if isinstance(f, S.In) else f.value))
            elif isinstance(f, S.IsNotNull) and name in ("symbol", "dt"):
                continue  # neither is ever missing
            else:
                yield f

    def partitions(self) -> list[Archive]:
        holds = {"eq": lambda x, v: x == v, "lt": lambda x, v: x < v, "le": lambda x, v: x <= v, "gt": lambda x, v: x > v, "ge": lambda x, v: x >= v, "in": lambda x, v: x in v}
        return [a for a in listed(self.folder, self.kind) if all(holds[op](a.symbol if name == "symbol" else a.day, v) for name, op, v in self.tests)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, where = store(self.folder)
        with files.open_input_file(partition.path) as f:
            rows = self.books(f) if self.kind == "books" else self.trades(f, partition.path)
            for columns in rows:
                n = len(columns["ts_ms"])
                columns |= {"symbol": pa.array([partition.symbol] * n, pa.string()), "dt": pa.array([partition.day] * n, pa.date32())}
                yield pa.RecordBatch.from_arrays([columns[c].cast(self.schema.field(c).type) for c in self.schema.names], schema=self.schema)

    def trades(self, f: pa.NativeFile, path: str) -> Iterator[dict[str, pa.Array]]:
        """Trades of one archive in their order; lines without a time, price or size that is a number are left
        out.  ``seq`` is the trade's own number, or its line."""
        if path.endswith(".gz"):
            yield from self.lines(gzip.open(f), ("timestamp", "side", "size", "price"), True, 0)
            return
        with zipfile.ZipFile(f) as z:
            names = [n for n in z.namelist() if n.lower().endswith(".csv")] or z.namelist()
            if not names:
                return
            with z.open(names[0]) as peek:
                header = not re.match(rb"\s*\d", peek.readline().removeprefix(b"\xef\xbb\xbf"))
            with z.open(names[0]) as raw:
                yield from self.lines(raw, ("c0", "c1", "c2", "c3", "c4", "c5", "c6"), False, int(header))

    def lines(self, raw: io.BufferedIOBase, names: tuple[str, ...], timed: bool, skip: int) -> Iterator[dict[str, pa.Array]]:
        text = dict.fromkeys(names, pa.string())
        options = {"convert_options": pyarrow.csv.ConvertOptions(column_types=text, include_columns=list(names))}
        if not timed:
            options["read_options"] = pyarrow.csv.ReadOptions(column_names=list(names), skip_rows=skip)
        at = 0
        try:
            batches = pyarrow.csv.open_csv(raw, **options)
        except pa.ArrowInvalid as e:
            if "Empty CSV" in str(e):
                return
            raise
        for batch in batches:
            number = lambda c, b=batch: _numbers(b.column(c))
            if timed:
                out = {"ts_ms": pc.cast(pc.trunc(pc.multiply(number("timestamp"), 1000.0)), pa.int64(), safe=False), "seq": pa.array(range(at, at + batch.num_rows)), "price": number("price"), "qty": number("size")}
                out["is_buyer_maker"] = pc.equal(pc.utf8_lower(pc.utf8_trim_whitespace(batch.column("side"))), "sell")
            else:
                whole = lambda c: pc.cast(number(c), pa.int64(), safe=False)
                out = {"ts_ms": whole("c5"), "seq": whole("c0"), "price": number("c1"), "qty": number("c2")}
                out["is_buyer_maker"] = pc.equal(pc.utf8_lower(pc.utf8_trim_whitespace(batch.column("c6"))), "true")
            at += batch.num_rows
            good = pc.and_(pc.and_(pc.is_valid(out["ts_ms"]), pc.is_valid(out["seq"])), pc.and_(pc.is_finite(pc.fill_null(out["price"], float("nan"))), pc.is_finite(pc.fill_null(out["qty"], float("nan")))))
            yield {k: v.filter(good) for k, v in out.items()}

    def books(self, f: pa.NativeFile) -> Iterator[dict[str, pa.Array]]:
        """Messages of one archive, a line of JSON each; lines that are none are left out."""
        level = lambda xs: [{"price": _number(x, 0), "size": _number(x, 1)} for x in xs or [] if isinstance(x, list)]
        with zipfile.ZipFile(f) as z:
            if not z.namelist():
                return
            with z.open(z.namelist()[0]) as raw:
                at, more = 0, True
                while more:
                    out: dict[str, list] = {k: [] for k in ("ts_ms", "seq", "type", "b", "a")}
                    for _ in range(LINES):
                        line = raw.readline()
                        if not line:
                            more = False
                            break
                        at += 1
                        try:
                            r = json.loads(line)
                            ts, kind, data = int(r["ts"]), r["type"], r.get("data") or {}
                        except (ValueError, KeyError, TypeError, AttributeError):
                            continue
                        for k, v in (("ts_ms", ts), ("seq", at - 1), ("type", kind), ("b", level(data.get("b"))), ("a", level(data.get("a")))):
                            out[k].append(v)
                    yield {k: pa.array(v, self.schema.field(k).type) for k, v in out.items()}


def _number(x: list, i: int) -> float | None:
    try:
        return float(x[i])
    except (ValueError, TypeError, IndexError):
        return None


def _numbers(column: pa.Array) -> pa.Array:
    """As doubles; what is no number is missing."""
    trimmed = pc.utf8_trim_whitespace(column)
    good = pc.match_substring_regex(trimmed, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return pc.cast(pc.if_else(good, trimmed, None), pa.float64())


class Writer(S.DataSourceArrowWriter):
    """An archive of trades for each instrument and day that a task has: rows must come dealt by day."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> S.WriterCommitMessage:
        files, where = store(self.folder)
        files.create_dir(where, recursive=True)
        made, now, out = [], None, None

        def close() -> None:
            for x in reversed(out or []):
                x.close()

        try:
            for batch in iterator:
                for r in batch.select(["symbol", "dt", "seq", "price", "qty", "ts_ms", "is_buyer_maker"]).to_pylist():
                    if (r["symbol"], r["dt"]) != now:
                        close()
                        now = (r["symbol"], r["dt"])
                        name = f"{r['symbol']}-aggTrades-{r['dt']}"
                        sink = files.open_output_stream(f"{where}/{name}.zip")
                        z = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                        out = [sink, z, z.open(f"{name}.csv", "w")]
                        made.append(name)
                    out[2].write(f"{r['seq']},{r['price']!r},{r['qty']!r},0,0,{r['ts_ms']},{str(r['is_buyer_maker']).lower()}\n".encode())
        finally:
            close()
        return S.WriterCommitMessage()


class Archives(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return BOOKS if self.options.get("kind") == "books" else TRADES

    def reader(self, schema) -> Reader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return Reader(self.options["path"], self.options.get("kind", "trades"), to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make ``format("archives")`` known to the session, with its filters pushed into the listing."""
    spark.dataSource.register(Archives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archives(spark: SparkSession, folder: str, kind: str = "trades") -> DataFrame:
    register(spark)
    return spark.read.format("archives").option("kind", kind).load(folder)


def write_archives(trades: DataFrame, folder: str) -> None:
    """Trades (symbol, dt, ts_ms, seq, price, qty, is_buyer_maker) as an archive for each instrument and day.

    An archive is one file, so a day of an instrument is written by one task, in order of time.
    """
    register(trades.sparkSession)
    columns = ["symbol", "dt", "ts_ms", "seq", "price", "qty", "is_buyer_maker"]
    trades.select(columns).repartition("symbol", "dt").sortWithinPartitions("symbol", "dt", "ts_ms", "seq").write.format("archives").mode("append").save(folder)


def write_checksums(digests: DataFrame, folder: str) -> None:
    """Rows (name, stated) as files ``NAME.CHECKSUM`` of one line each, as venues publish them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = store(folder)
        files.create_dir(where, recursive=True)
        for batch in batches:
            for name, stated in zip(*(batch.column(c).to_pylist() for c in ("name", "stated")), strict=True):
                with files.open_output_stream(f"{where}/{name}.CHECKSUM") as f:
                    f.write(f"{stated}  {name}\n".encode())
            yield batch.select(["name"])

    digests.select("name", "stated").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def verify(spark: SparkSession, archives: str, checksums: str) -> DataFrame:
    """(name, algorithm, stated, found, status) of files against files of checksums named ``NAME.CHECKSUM``.

    The first word of a checksum file is the digest; its length tells the algorithm (64: sha256, 32: md5).
    ``status`` is "good", "bad", "no checksum", "unknown algorithm", or "missing or empty" for a stated file
    that is not there.  A digest needs its whole file: files of over 2 GB do not fit.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    lists = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.CHECKSUM").load(checksums)
    word = F.lower(F.regexp_extract(F.col("content").cast("string"), r"^\s*(\S+)", 1))
    stated = lists.select(F.regexp_replace(name, r"\.CHECKSUM$", "").alias("name"), word.alias("stated"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{zip,gz}").load(archives)
    digests = files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    met = digests.withColumn("_there", F.lit(True)).join(stated, "name", "full")
    algorithm = F.when(F.length("stated") == 64, "sha256").when(F.length("stated") == 32, "md5")
    found = F.when(algorithm == "sha256", F.col("sha256")).when(algorithm == "md5", F.col("md5"))
    status = F.when(F.col("_there").isNull(), "missing or empty").when(F.col("stated").isNull(), "no checksum").when(algorithm.isNull(), "unknown algorithm").when(found == F.col("stated"), "good").otherwise("bad")
    return met.select("name", algorithm.alias("algorithm"), "stated", found.alias("found"), status.alias("status"))
