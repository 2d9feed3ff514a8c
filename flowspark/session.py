"""The session settings that results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "flowspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution.  ``conf``: further settings, ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of our own is used only in local mode, where one process does everything; elsewhere an
    unset folder is an error, not a silent local one.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-flowspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; :func:`clear` deletes what is written there."""
    path = f"{shared_dir(spark)}/flowspark-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: later steps do not recompute it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many paths :func:`scratch` has given out: a mark for :func:`clear`."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete what operators have stored since a mark.  Results that read it must be written by then."""
    conf = spark._jsc.hadoopConfiguration()
    for path in _made[since:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    del _made[since:]
