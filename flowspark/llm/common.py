"""Helpers shared by the training-data operators.

Words are the runs ``[^\\x20\\x09-\\x0D]+``.  ``bytes.split()`` without an argument cuts at exactly
those six ASCII characters, so Python code splits the UTF-8 bytes; SQL code uses ``WORD``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import clear, made, scratch, shared_dir, stored

__all__ = ["GAP", "SLICE", "WORD", "by_bytes", "clear", "cut", "made", "map_rows", "pick", "sample_ids", "scratch", "shared_dir", "stored", "table", "text_key", "words_by_space"]

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows a Python helper holds as objects at once, and bytes of text that it works on at once.
SLICE, SLICE_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: later reads survive a lost executor and do not recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` over small slices of columns.

    ``start()`` runs once in each task and returns the function that turns a slice (column name to
    list) into the output columns.  Only ``SLICE`` rows exist as Python objects at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = work(batch.slice(at, SLICE).to_pydict())
                yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under its own names: extra columns cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def sample_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (doc_id, ...), chosen by a hash of the id: the same on every run."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def text_key(text: str = "text") -> Column:
    """64 bits of a text; with the id, it tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def by_bytes(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of at most ``most`` bytes of ``column``, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def words_by_space(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, number of each word in order, offsets of the texts) of ``texts`` cut at each
    space.  Texts must not be null."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy()
