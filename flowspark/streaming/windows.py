"""Windows over a stream of events, and how a stream is run to the end of what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import scratch


def events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of event files at ``path``, a folder or one file, with the time as ``at``."""
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", 64)
    folder, _, name = path.rpartition("/")
    if any(f.endswith(f"/{name}") for f in now.inputFiles()):  # a stream takes folders only
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def by_window(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count and sum of ``value`` in tumbling or, with ``slide``, sliding windows.  A window is out when
    the latest time seen is ``late`` past its end; later rows of it are left out."""
    window = F.window("at", size, slide) if slide else F.window("at", size)
    sums = stream.withWatermark("at", late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), *keys, "n", "total")


def by_session(stream: DataFrame, gap: str, late: str = "1 hour", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Count and sum of ``value`` in sessions: rows of a key less than ``gap`` apart."""
    sums = stream.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), *keys, "n", "total")


def replay(df: DataFrame, order: str, label: str, triggers: int = 4) -> DataFrame:
    """``df`` as a stream that arrives in ``triggers`` parts along ``order``, a file each.

    Parts are cut evenly between the smallest and the largest value.  A stream takes files by their time, so
    that is set along the order.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, f"replay-{label}")
    ends = df.agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    part = F.floor((F.col(order) - F.col("_low")) * triggers / (F.col("_high") - F.col("_low") + 1)).cast("int")
    dealt = df.join(F.broadcast(ends)).withColumn("_part", part).drop("_low", "_high")
    dealt.repartition("_part").write.partitionBy("_part").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for n in range(triggers):
        for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_part={n}/*.parquet")) or []:
            files.setTimes(status.getPath(), 1_600_000_000_000 + n * 60_000, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Run the stream over all that has arrived, into Parquet in the shared folder, and read that.

    State is held in RocksDB, which maps, lists and timers need; the setting is that of this run only.
    """
    spark = stream.sparkSession
    home = scratch(spark, f"stream-{label}")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start(f"{home}/rows")
    finally:
        spark.conf.set(store, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")
