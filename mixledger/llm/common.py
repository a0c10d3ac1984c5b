"""What several operators share: reading tables, ASCII words, and tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A word is a run of code points that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a worker turns into Python values at once.
SLICE_ROWS = 500
#: Rows that Spark hands to a Python worker at once where whole texts go through it.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z in lower case; white space is space and 09 to 0D.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is just what is asked for.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in order, cut into views of a few rows, so that a worker holds the results of those only."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:  # a worker lives on, with all that its allocator keeps
        pa.default_memory_pool().release_unused()


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session's Arrow batches hold ``rows`` rows at most.

    Batches of 10,000 long texts, Spark's default, are held by the executor and its workers at once,
    outside the heap. The setting is read when a plan is run, so it stays after the call.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


#: Folders of the tables written since each open ``scratch`` block began.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go when the block ends, but for those staged as ``lasting``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, lasting: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, for results that several later jobs read.

    Columnar and compressed, so later jobs read only the columns they name, and a lost executor
    costs a re-read. The folder is ``spark.checkpoint.dir``; where that is unset (tests),
    the session's own checkpoint is used.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return cut_lineage(df)
    path = f"{shared.rstrip('/')}/tables/{uuid.uuid4().hex}"
    if _open and not lasting:
        _open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
